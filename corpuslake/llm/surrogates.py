"""Personal data replaced by keyed, type-consistent surrogates. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, materialize, read

#: Given names by script and gender; a surrogate comes from the same list (fixed values).
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Emma", "Laura", "Sofia", "Julia", "Clara", "Alice", "Elena", "Marie", "Sarah", "Nina"],
    ("latin", "m"): ["John", "Peter", "Paul", "Thomas", "Daniel", "Martin", "Lucas", "David", "Hugo", "Carlos", "Robert", "Felix"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Павел", "Сергей", "Андрей", "Николай"],
}
#: Titles by gender, particles of surnames, and titles that follow a name of other scripts (fixed values).
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "госпожа", "г-жа", "Κυρία"], "m": ["Mr", "Herr", "Señor", "Monsieur", "господин", "г-н", "Κύριος"], "": ["Dr", "Prof"]}
PARTICLES = ["van", "von", "der", "den", "de", "di", "du", "la", "le"]
AFTER = {"han": ["先生", "女士", "小姐"], "kana": ["さん"], "hangul": [" ?씨"]}
#: Common Chinese surnames, and characters that end what stands before a name and are in none (fixed values).
HAN_SURNAMES = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 高 林 罗 郑 梁 谢 宋 唐 许 韩 冯 邓 曹 彭 曾 肖 田 董 袁 潘 于 蒋 蔡 余 杜 叶 程 苏 魏 吕 丁 任 沈 姚 卢 姜 崔 钟 谭 陆 汪 范 金 石 廖 贾 夏 韦 付 方 白 邹 孟 熊 秦 邱 江 尹 薛 闫 段 雷 侯 龙 史 陶 黎 贺 顾 毛 郝 龚 邵 万 钱 严 覃 武 戴 莫 孔 向 汤".split()
HAN_PARTICLES = "我你他她它们和与跟对向的是在了请让给由被把这那有见叫到从说及或"
#: Syllables that surrogate surnames are made of (fixed values).
SYLLABLES = {
    "latin": ["bar", "del", "fen", "gor", "hal", "jen", "kor", "lin", "mar", "nor", "pel", "ros", "sal", "tor", "vel", "wen"],
    "cyrillic": ["бар", "вел", "гор", "дан", "зор", "кар", "лин", "мор", "нов", "пел", "рос", "сал", "тор", "фен", "хал", "юр"],
    "greek": ["βαρ", "γορ", "δελ", "ζαν", "καρ", "λιν", "μορ", "νικ", "παλ", "ροδ", "σαλ", "τορ", "φεν", "χαλ"],
    "han": ["安", "白", "成", "东", "方", "高", "海", "江", "林", "明", "宁", "平", "秋", "山", "田", "文", "夏", "雪", "云", "竹"],
    "kana": ["あき", "かね", "さと", "たか", "なか", "はま", "まつ", "やま", "よし", "ふじ", "きた", "しま"],
    "hangul": ["강", "고", "남", "도", "민", "박", "서", "송", "안", "오", "윤", "정", "조", "차", "하", "한"],
}
#: How a script is told: by the first letter.
_SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "hangul": "IsHangul", "kana": "[\\p{IsKatakana}\\p{IsHiragana}]"}
_TITLE = "|".join(t for x in TITLES.values() for t in x)
_NAME = "|".join(n for x in GIVEN.values() for n in x)
_SURNAME = r"(?:(?:" + "|".join(PARTICLES) + r") ){0,3}\p{Lu}(?:\p{L}|['’]\p{Lu}|-\p{Lu}\p{L})+"
_FIRST = rf"(?:(?:{_NAME}) ){{1,2}}(?:\p{{Lu}}\. ){{0,2}}"
#: After a title all words that begin with a capital belong to the name, and the last is the surname.
_TITLED = rf"(?:(?:\p{{Lu}}\.|\p{{Lu}}(?:\p{{L}}|['’]\p{{Lu}}|-\p{{Lu}}\p{{L}})+) ){{0,3}}"
_LOUD = rf"(?:(?:{_NAME.upper()}) ){{1,2}}\p{{Lu}}(?:\p{{Lu}}|['’]\p{{Lu}}|-\p{{Lu}})+(?!\p{{L}})"
_FORMS = {
    # a listed surname and up to two more characters wherever they stand; else up to three characters that nothing of the script precedes
    "han": rf"(?:{'|'.join(HAN_SURNAMES)})[\p{{IsHan}}&&[^{HAN_PARTICLES}]]{{0,2}}|(?<!\p{{IsHan}})[\p{{IsHan}}&&[^{HAN_PARTICLES}]]{{1,3}}",
    "kana": r"[\p{IsHan}]{1,3}|[\p{IsKatakana}ー]{2,8}|(?<![\p{IsHan}\p{IsHiragana}])[\p{IsHiragana}]{2,6}",
    "hangul": r"(?<!\p{IsHangul})[\p{IsHangul}]{1,4}",
}
_BEHIND = "|".join(f"(?:{_FORMS[script]})(?={'|'.join(titles)})" for script, titles in AFTER.items())
#: Patterns of each kind, in the order in which they win.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++){1,30}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": "|".join([
        r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"\+[0-9]{1,3}(?:[ .-][0-9])?(?:[ .-][0-9]{2,8}){2,5}(?![0-9])",
        r"\+[0-9]{1,3}[ .-][0-9]{6,12}(?![0-9])",
        r"\+[0-9]{4,8}(?:[ .-][0-9]{2,8}){1,4}(?![0-9])",
        r"\+[0-9]{7,15}(?![0-9])",
        r"(?<![0-9])(?<![0-9][.-])0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9]|[.-][0-9])",
        r"(?<![0-9])(?<![0-9][.-])(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9]|[.-][0-9])",
    ]),
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? {_TITLED}{_SURNAME}|{_FIRST}{_SURNAME}|{_LOUD})|{_BEHIND}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match of any pattern holds, and is cheap to find; documents without it are not looked at again.
CHEAP = rf"@|[0-9]{{3}}|\+[0-9]|(?:[0-9]{{1,3}}\.){{3}}|(?<!\p{{L}})(?:{_TITLE}|{_NAME}|{_NAME.upper()})(?!\p{{L}})|{'|'.join(t for x in AFTER.values() for t in x)}"
#: A text's words and what stands between them, one after another.
TOKEN = r"\p{L}(?:\p{L}|['’]\p{Lu}|-\p{L})*|[^\p{L}]+"


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def norm(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same: an address without case, digits without their format (nor the 1 before a number of ten), a surname
    in small letters but for the first, with one kind of apostrophe."""
    surname = F.translate(F.element_at(F.split(entity, " "), -1), "’", "'")
    surname = F.when(_loud(entity), F.concat(F.substring(surname, 1, 1), F.lower(F.substr(surname, F.lit(2))))).otherwise(surname)
    number = F.when(kind == "phone", F.regexp_replace(_digits(entity), "^1(?=[0-9]{10}$)", "")).otherwise(_digits(entity))
    return F.when(kind == "email", F.lower(entity)).when(kind == "name", surname).when(kind == "ip", entity).otherwise(number)


def _loud(name: Column) -> Column:
    """Several words in capitals throughout, of a script that has them."""
    return (F.upper(name) == name) & (F.lower(name) != name) & F.contains(name, F.lit(" ")) & ~F.regexp_like(name, F.lit(r"\."))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a 64-byte hex stream, over and over."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _reshaped(text: Column, stream: Column) -> Column:
    """Every letter and digit replaced by a keyed one of its own class; the rest stays."""

    def one(i: Column) -> Column:
        c, v = F.substring(text, i + 1, F.lit(1)), _byte(stream, i)
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike(r"\p{L}"), F.char(v % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")


def _number(digits: Column, lead: Column, stream: Column, phone: Column) -> Column:
    """Other digits after the first `lead`; of long phone numbers area and exchange start with 2 to 9, as real ones do."""

    def one(i: Column) -> Column:
        v, back = _byte(stream, i), F.length(digits) - i
        return F.when(i < lead, F.substring(digits, i + 1, F.lit(1))).when(phone & (F.length(digits) >= 10) & back.isin(7, 10), (v % 8 + 2).cast("string")).otherwise((v % 10).cast("string"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), "")


def _address(value: Column, stream: Column, attempt: int) -> Column:
    """An address of the same kind: private, loopback and link-local ranges keep theirs, all others get one of the reserved range
    240.0.0.0/4. Where a range is used up, wider ones follow."""
    own, byte = F.split(value, r"\."), lambda i: (_byte(stream, F.lit(i)) % 254 + 1).cast("string")
    a, b = F.get(own, F.lit(0)).cast("int"), F.get(own, F.lit(1)).cast("int")
    four = lambda *parts: F.concat_ws(".", *parts)
    reserved = four((_byte(stream, F.lit(9)) % (15 if attempt < 24 else 223) + (240 if attempt < 24 else 1)).cast("string"), byte(1), byte(2), byte(3))
    ten = four(F.lit("10"), byte(1), byte(2), byte(3))
    small = lambda narrow: narrow if attempt < 12 else ten if attempt < 24 else reserved
    return (
        F.when(a == 10, ten if attempt < 24 else reserved).when(a == 127, four(F.lit("127"), byte(1), byte(2), byte(3)))
        .when((a == 192) & (b == 168), small(four(F.lit("192.168"), byte(2), byte(3)))).when((a == 172) & b.between(16, 31), small(four(F.lit("172"), (_byte(stream, F.lit(1)) % 16 + 16).cast("string"), byte(2), byte(3))))
        .when((a == 169) & (b == 254), small(four(F.lit("169.254"), byte(2), byte(3)))).otherwise(reserved)
    )


def _luhn(digits: Column) -> Column:
    """Digits whose last one makes the Luhn sum right."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(body) - 1), worth), F.lit(0), lambda a, b: a + b)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _word(text: Column, stream: Column, syllables: int) -> Column:
    """A word of the text's script."""
    made = lambda script: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _byte(stream, i) % len(SYLLABLES[script]) + 1)), "")
    out = made("latin")
    for script, form in _SCRIPTS.items():
        out = F.when(text.rlike(rf"^\p{{{form}}}" if form.startswith("Is") else f"^{form}"), made(script)).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """The surrogate of a normal form at an attempt: same kind, length of digits and script. Later attempts draw from wider forms."""
    stream = F.sha2(F.concat_ws("\x00", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    local, digits = F.substring_index(value, "@", 1), _digits(value)
    more = "" if attempt < 8 else _byte(stream, F.lit(60)).cast("string") if attempt < 16 else F.concat(*(_byte(stream, F.lit(i)).cast("string") for i in (58, 59, 60, 61)))
    email = F.concat(_reshaped(local, stream), F.lit(more) if isinstance(more, str) else more, F.lit("@"), F.substring_index(value, "@", -1))
    # the leading digits say which kind of number it is: a country and area, or a card's issuer
    lead = F.lit(0) if attempt >= 24 else F.when(kind == "ssn", 0).when(kind == "phone", F.greatest(F.lit(0), F.length(digits) - 9)).otherwise(1)
    number = _number(digits, lead, stream, kind == "phone")
    name, domain = F.initcap(_word(value, stream, 2 + attempt % 8)), F.concat(_word(F.lit("a"), stream, 3 + attempt % 8), F.lit(".example.org"))
    return F.when(kind == "email", email).when(kind == "ip", _address(value, stream, attempt)).when(kind.isin("name", "given"), name).when(kind == "domain", domain).when(kind == "card", _luhn(number)).otherwise(number)


def surrogate_map(entities: DataFrame, key: str, rounds: int = 200) -> DataFrame:
    """(kind, value) -> new: one-to-one within a kind, and never a value that the corpus holds.

    Every value proposes its surrogate; where several propose the same one the least value gets it, and none gets a value
    that stands in the corpus or is taken. The others try again with the next attempt, which draws from a wider form where
    many have failed, until all have one. Only if a form itself has fewer values than the corpus does this end in an error."""
    own = materialize(entities.select("kind", "value").distinct(), "pii-values")
    spark, done, pending, attempt = own.sparkSession, None, own, 0
    # few bytes, but much work a row: dealt out by rows, not by size
    tasks = max(spark.sparkContext.defaultParallelism, -(-own.count() // 5_000))
    while True:
        tried = pending.repartition(tasks, "kind", "value").withColumn("new", surrogate(F.col("kind"), F.col("value"), attempt, key))
        winner = tried.groupBy("kind", "new").agg(F.min("value").alias("value"))
        taken = own.select("kind", F.col("value").alias("new"))
        taken = taken if done is None else taken.union(done.select("kind", "new"))
        won = materialize(winner.join(taken, ["kind", "new"], "left_anti").select("kind", "value", "new"), "pii-won")
        done = won if done is None else materialize(done.union(won), "pii-done")
        pending = materialize(pending.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "pii-pending")
        if not pending.limit(1).count():
            return done
        attempt += 1
        if attempt >= rounds:
            raise ValueError(f"no distinct surrogates after {rounds} attempts on {spark.sparkContext.appName}")


def _filled(entity: Column, digits: Column) -> Column:
    """The mention's own format with other digits."""
    gaps = F.split(entity, "[0-9]")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)))
    return F.array_join(F.zip_with(gaps, each, lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def given_names(key: str) -> dict[str, str]:
    """Given name -> surrogate: in each list of a script and gender the next one in a keyed order, so one-to-one and never itself."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda x: hashlib.sha256(f"{key}{x}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _given(key: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in given_names(key).items() for x in pair))


def _plain(entity: Column) -> Column:
    """A name's words but the last, small letters after the first where all are capitals."""
    tokens = F.split(entity, " ")
    head = F.slice(tokens, 1, F.size(tokens) - 1)
    return F.when(_loud(entity), F.transform(head, lambda t: F.initcap(t))).otherwise(head)


def _others(entity: Column) -> Column:
    """Given names that are in no list: capitalised words before the surname that are no title, initial or particle."""
    known = [*(t for x in TITLES.values() for t in x), *PARTICLES, *(n for x in GIVEN.values() for n in x)]
    return F.array_distinct(F.filter(_plain(entity), lambda t: t.rlike(r"^\p{Lu}\p{L}") & ~F.rtrim(t, F.lit(".")).isin(*known)))


def _named(entity: Column, surname: Column, others: Column, key: str) -> Column:
    """Titles, initials and particles kept, given names from the list of their script and gender (or as others says), and the surname given."""
    head = F.transform(_plain(entity), lambda t: F.coalesce(F.try_element_at(_given(key), t), F.try_element_at(others, t), t))
    out = F.array_join(F.concat(head, F.array(surname)), " ")
    return F.when(_loud(entity), F.upper(out)).otherwise(out)


def pseudonymize(docs: DataFrame, key: str = "surrogates-1") -> tuple[DataFrame, dict[str, str]]:
    """docs (doc_id, text and others) with the entities of text replaced, and one count column a kind (n_email, n_ip, ...; names as returned).

    Mentions of one entity get one surrogate all over the corpus whatever their format (coreference), different entities different
    ones (distinctness, checked over all documents); a surrogate has the mention's format, script and length of digits, a card number
    its check digit, a given name its gender (one that is in no list gets a made-up one), a private address its range. Addresses of one domain share their new one, which is
    reserved for examples; public IP addresses become reserved ones. Where a document names a person, their surname and given name
    alone are replaced in it as well, wherever they stand (not counted). A different key gives different surrogates.

    Only mentions are shuffled, first reduced to distinct entities; an entity that a third of all documents mention is one
    row there, and Spark splits its mentions where they meet their surrogate. Null and empty texts stay; repeated rows get equal results.
    """
    names = {f"n_{x}": fresh(docs.columns, f"n_{x}") for x in PATTERNS}
    k, j, new, aliases = (fresh(docs.columns, x) for x in ("k", "j", "replaced", "aliases"))
    text = F.coalesce("text", F.lit(""))
    keys = {"k": F.xxhash64("doc_id", text), "j": F.hash(text, "doc_id")}
    found = docs.where(F.col("text").rlike(CHEAP)).select(*(c.alias(n) for n, c in keys.items()), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "entity"))
    found = found.dropDuplicates(["k", "j", "pos"]).withColumn("kind", kind_of(F.col("entity"))).withColumn("value", norm(F.col("kind"), F.col("entity")))
    found = materialize(found.withColumn("host", F.when(F.col("kind") == "email", F.substring_index("value", "@", -1))), "pii-found")
    given = found.where("kind = 'name'").select("k", "j", "pos", F.explode(_others(F.col("entity"))).alias("word"))
    parts = found.where("host is not null").select(F.lit("domain").alias("kind"), F.col("host").alias("value")).union(given.select(F.lit("given").alias("kind"), F.col("word").alias("value")))
    mapped = surrogate_map(found.select("kind", "value").union(parts), key)
    kind, entity, value = F.col("kind"), F.col("entity"), F.col("new")
    hosts = mapped.where("kind = 'domain'").select(F.col("value").alias("host"), F.col("new").alias("new_host"))
    email = F.concat(F.substring_index(value, "@", 1), F.lit("@"), F.col("new_host"))
    digits = F.when((kind == "phone") & (F.length(_digits(entity)) > F.length(value)), F.concat(F.lit("1"), value)).otherwise(value)
    spelled = F.when(kind == "name", _named(entity, value, F.col("others"), key)).when(kind == "email", F.when(F.upper(entity) == entity, F.upper(email)).otherwise(email)).when(kind == "ip", value).otherwise(_filled(entity, digits))
    others = given.join(mapped.where("kind = 'given'").select(F.col("value").alias("word"), "new"), "word").groupBy("k", "j", "pos").agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("others"))
    met = found.join(mapped, ["kind", "value"]).join(others, ["k", "j", "pos"], "left")
    swaps = met.join(hosts, "host", "left").select("k", "j", "pos", "kind", spelled.alias("other"), "entity", "value", "new", "others")
    counts = [F.count_if(F.col("kind") == x).alias(names[f"n_{x}"]) for x in PATTERNS]
    own = F.array(F.struct(F.col("value").alias("word"), F.col("new").alias("other")))
    first = lambda t: F.coalesce(F.try_element_at(_given(key), t), F.try_element_at("others", t))
    heads = F.transform(F.filter(_plain(F.col("entity")), lambda t: first(t).isNotNull()), lambda t: F.struct(t.alias("word"), first(t).alias("other")))
    swaps = materialize(swaps.withColumn("people", F.when(kind == "name", F.concat(own, heads))).drop("entity", "value", "new", "others"), "pii-swaps")
    people = swaps.where("people is not null").select("k", "j", F.explode("people").alias("p")).groupBy("k", "j", "p.word").agg(F.min("p.other").alias("other"))
    people = people.groupBy("k", "j").agg(F.map_from_entries(F.collect_list(F.struct("word", "other"))).alias(aliases))
    swaps = swaps.groupBy("k", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda s: s["other"]).alias(new), *counts)
    swaps = swaps.join(people, ["k", "j"], "left").withColumnsRenamed({"k": k, "j": j})
    # the same join at every size: what a small corpus could broadcast a large one can't
    out = docs.withColumns({k: keys["k"], j: keys["j"]}).join(swaps.hint("merge"), [k, j], "left")
    same = lambda t: F.coalesce(F.try_element_at(aliases, t), F.try_element_at(aliases, F.translate(t, "’", "'")), t)
    words = lambda piece: F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(TOKEN), F.lit(0)), same), "")
    # names of a script without blanks stand inside longer runs
    inside = lambda piece: F.aggregate(F.filter(F.map_keys(aliases), lambda w: w.rlike(r"^[\p{IsHan}\p{IsKatakana}\p{IsHiragana}]{2,}$")), piece, lambda p, w: F.replace(p, w, F.try_element_at(aliases, w)))
    again = lambda piece: F.when(F.col(aliases).isNull(), piece).otherwise(inside(words(piece)))
    woven = F.array_join(F.zip_with(F.split("text", ANY), new, lambda a, b: F.concat(again(a), F.coalesce(b, F.lit("")))), "")
    columns = [woven_if.alias("text") if c == "text" else F.col(c) for c in docs.columns for woven_if in [F.when(F.col(new).isNull(), F.col("text")).otherwise(woven)]]
    return out.select(*columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names.values())), names


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of entities of each kind."""
    out, _ = pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out
