import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import text as X
from corpuslake.operators import checks, dedup, dialogue, reports, retrieval, scenes, sft
from corpuslake.operators.tables import numbered
from corpuslake.plans import suite
from corpuslake.sources import io
from corpuslake.streaming import sessions


def tree(rng, depth=0):
    items = []
    for _ in range(rng.randint(1, 4)):
        item = {"id": str(rng.randint(0, 9)), "speaker": rng.choice(["Ego", "Bo", "Ego & Bo"]), "text": f"t{rng.randint(0, 999)}"}
        if depth < 3 and rng.random() < 0.4:
            item["choices"] = [{"id": rng.choice(["", "a", "b"]), "text": f"c{rng.randint(0, 99)}", "response": tree(rng, depth + 1)} for _ in range(rng.randint(1, 3))]
        items.append(item)
    return items


def walk(items, context, size, out):
    context = list(context)
    for item in items:
        if "Ego" in item["speaker"]:
            out.append((item["text"], [c for c in context[-size:]]))
        context.append(item["text"])
        for choice in item.get("choices", []):
            walk(choice["response"], [*context, choice["text"]], size, out)


def test_context_is_a_sequential_walk(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for i in range(40):
        items = tree(rng)
        docs.append((i, json.dumps({"x": [{"talkId": i + 1, "dialogues": items}]})))
        walk(items, [], 3, want.setdefault(i, []))
    rows = spark.createDataFrame([*docs, (99, "{bad")], "doc int, json string")
    assert [r.doc for r in dialogue.flatten_documents(rows)[1].collect()] == [99]
    got = dialogue.preceding_context(rows, F.contains("speaker", F.lit("Ego")), 3).orderBy("doc", "pos").collect()
    for i, w in want.items():
        assert [(r.text, [c.text for c in r.context_before]) for r in got if r.doc == i] == w
    with pytest.raises(ValueError):
        dialogue.preceding_context(rows, F.lit(True), 0)
    plain = dialogue.flatten_documents(rows)[0].collect()
    assert all(r.context_before == [] for r in plain) and len(plain) == dialogue.flatten_documents(rows, context=2)[0].count()


def test_scene_containers_and_ids(spark):
    body = {"quest": {"id": 7}, "meta": {"dialogues": [{"speaker": "A", "text": "1", "choices": [{"id": "x", "text": "c", "response": [{"speaker": "B", "text": "2"}]}, {"id": "", "text": "d"}]}, "junk", {"speaker": "A", "text": "3"}], "inner": {"id": 0, "initDialog": 5, "dialogues": [{"speaker": "C", "text": "4"}]}}}
    docs = spark.createDataFrame([("Quest/1.json", json.dumps(body))], "source_file string, json string")
    t = dialogue.flatten_documents(io.document_metadata(docs))[0].orderBy("scene_id", "pos").collect()
    assert [(r.scene_id, r.pos, r.text, r.kind, r.branch_path) for r in t] == [("5", 0, "4", "dialogue", []), ("meta", 0, "1", "dialogue", []), ("meta", 1, "c", "choice", ["x"]), ("meta", 2, "2", "dialogue", ["x"]), ("meta", 3, "d", "choice", [""]), ("meta", 4, "3", "dialogue", [])]
    assert t[0].document_id == "7"


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "root/Quest").mkdir(parents=True)
    (tmp_path / "root/Quest/Quest_1.json").write_text('{"talkId": 3, "who": "Ego"}')
    (tmp_path / "root/Quest/Quest_2.json").write_text("{")
    (tmp_path / "root/other.json").write_text('{"id": "q"}')
    good, bad = io.json_tree(spark, f"{tmp_path}/root")
    assert sorted((r.source_file, r.source_type) for r in good.collect()) == [("Quest/Quest_1.json", "Quest"), ("other.json", "other.json")]
    assert [r.source_file for r in bad.collect()] == ["Quest/Quest_2.json"]
    assert io.json_tree(spark, f"{tmp_path}/root", "Quest_*.json", holds="Ego")[0].count() == 1
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": null}\nnot json\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    rows, errors = io.json_lines(spark, f"{tmp_path}/rows.jsonl", schema)
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r[1] for r in errors.collect()] == ["not json"]
    io.write_json_lines(rows, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").where("value like '%\"b\":null%'").count() == 2
    io.write_lines(rows, "a", f"{tmp_path}/lines")
    assert sorted(r.a for r in io.read_lines(spark, f"{tmp_path}/lines", "a").collect()) == ["1", "2"]
    io.write_tsv(spark.createDataFrame([("x\ty", 1)], "t string, n int"), f"{tmp_path}/tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").first().t == "x y"
    io.write_cards(spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int"), "k", f"{tmp_path}/cards")
    assert spark.read.json(f"{tmp_path}/cards").count() == 2
    hashes = io.file_hashes(spark, f"{tmp_path}/root")
    assert hashes.count() == 3 and all(len(r.sha256) == 64 for r in hashes.collect())
    cards = io.card_folder(spark, f"{tmp_path}/root/other.json", T.StructType([T.StructField("id", T.StringType())])).collect()
    assert [(r.id, r.card_file) for r in cards] == [("q", "other")]


def test_a_packed_tree_reads_as_its_files(spark, tmp_path):
    files = {"Quest/Quest_1.json": '{"talkId": 3, "who": "Ego"}', "Quest/Quest_22.json": "{", "a/b/c/Quest_3.json": '[1, "Ego"]', "other.json": '{"id": "q"}', "a/Quest_1.json.bak": "{}"}
    for name, text in files.items():
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(text)
    io.write_packed(spark.createDataFrame(list(files.items()), "name string, body string"), "name", "body", f"{tmp_path}/pack")
    found = []
    for how in ({}, {"pattern": "*"}, {"pattern": "Quest_?.json"}, {"pattern": "{other,Quest_[2-9]}*"}, {"holds": "Ego"}):
        plain, packed = ([sorted(map(tuple, t.collect())) for t in io.json_tree(spark, f"{tmp_path}/{at}", packed=at == "pack", **how)] for at in ("root", "pack"))
        assert plain == packed
        found.append((len(packed[0]), len(packed[1])))
    assert found == [(3, 1), (4, 1), (2, 0), (2, 1), (2, 0)]


def test_packed_sessions_read_as_their_files(spark, tmp_path):
    said = '"messages": [{"role": "user", "content": "a\\nb"}]'
    files = {
        "a/s1.json": f'{{"version": 1, {said}, "updated_at_ms": 5}}', "b/s3.json": f'\n{{"version": 1,\n{said}, "updated_at_ms": 5, "other": {{}}}}', "s2.json": f'{{"version": 1, {said}}}', "s4.json": f'{{"version": 2, {said}, "updated_at_ms": 9}}',
        "s5.json": '{"version": 1, "updated_at_ms": 9}', "s6.json": '{"version": 1, "messages": 3, "updated_at_ms": 9}', "s7.json": f'{{"version": 1, {said}, "updated', "s8.json": "", "s9.json": '{"version": 1, "messages": [], "updated_at_ms": 6}',
    }
    for name, text in files.items():
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(text)
    # only an object is a session, as for the reference
    more = {"t1.json": f'[{{"version": 1, {said}, "updated_at_ms": 9}}]', "t2.json": "null"}
    io.write_packed(spark.createDataFrame([*files.items(), *more.items()], "name string, body string"), "name", "body", f"{tmp_path}/pack")
    message = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("messages", message), T.StructField("updated_at_ms", T.LongType())])
    packed = io.sessions(spark, f"{tmp_path}/pack", schema, packed=True).collect()
    assert [(r.session_file, r.updated_at_ms) for r in packed] == [("s9.json", 6), ("s3.json", 5), ("s1.json", 5), ("s2.json", None)] and packed[1].messages[0].content == "a\nb"
    assert packed == io.sessions(spark, f"{tmp_path}/root/{{*.json,*/*.json}}", schema).collect()


def test_a_failed_write_leaves_the_old_data(spark, tmp_path):
    import os

    path, df = f"{tmp_path}/report", spark.range(10)
    io.write_report({"n": F.count("*")}, df, path)
    io.write_report({"n": F.sum("id")}, df, path)
    for _ in range(2):
        assert [r.n for r in spark.read.json(path).collect()] == [45] and os.listdir(tmp_path) == ["report"]
        with pytest.raises(Exception, match="stop"):
            io.write_report({"n": F.sum(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))}, df, path)


def test_templates(spark):
    page = "a {{voice|x\n|title=Hello {{b|c}}\n|text=One<br>two &amp; three\nmore\n|title=Last}} z {{voice\n|title=B\n|text=}} {{other|title=no}}"
    df = spark.createDataFrame([(1, page)], "page int, wikitext string")
    blocks = io.templates(df, "wikitext", "voice").withColumn("p", io.template_parameters(F.col("block")))
    category = lambda t: scenes.categorise(t, {"La": "last"}, [("set", ("Rain",), "weather"), ("prefix", ("About",), "about")], ("weather",))
    rows = scenes.voice_rows(blocks, "p", "block_index", "v", "en", category, "cc").orderBy("dialogue_id").collect()
    assert [(r.dialogue_id, r.voice_title, r.text, r.voice_group) for r in rows] == [("v_001", "Last", "One\ntwo & three\nmore", "combat"), ("v_002", "B", "", "profile")]
    titles = spark.createDataFrame([("Rain",), ("Rainy",), ("About us",), ("Last rain",)], "t string").select(category(F.col("t")).alias("c")).collect()
    assert [tuple(r.c) for r in titles] == [("profile", "weather", False), ("profile", "other_profile", True), ("profile", "about", True), ("combat", "last", False)]
    # the name is a prefix, and a bar without a key stays in the value
    df = spark.createDataFrame([(1, "{{voice/row\n|a=1\n| not a key\n|b=2}}")], "page int, wikitext string")
    assert io.templates(df, "wikitext", "voice").select(io.template_parameters(F.col("block")).alias("p")).first().p == {"a": "1\n| not a key", "b": "2"}
    with pytest.raises(Exception, match="not closed"):
        io.templates(spark.createDataFrame([(1, "{{voice|x")], "page int, wikitext string"), "wikitext", "voice").collect()


def test_text_functions(spark):
    one = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"t {kind}").select(c(F.col("t"))).first()[0]
    assert one(lambda t: X.resolve_markup(t, "Nick"), "#a{NICKNAME}{M#he}{F#she} {RUBY#[D]x}y{M#z}  \r\n\n\n\n#b") == "aNickshe yz\n\nb"
    assert one(X.clean_markup, "<b>a</b> &lt;x&gt;<br/>  <i> </i>\nb&amp;lt;") == "a <x>\nb&lt;"
    assert one(X.squash, " a 　b\n\tc ") == "a b c"
    assert one(X.semantic_length, "玛a1…é!") == 3
    fillers = lambda f: lambda t: f(t, ("嗯+", "oh"))
    assert one(fillers(X.is_filler), "「嗯嗯……」") and not one(fillers(X.is_filler), "嗯 yes") and one(fillers(X.starts_with_filler), "嗯, yes") and not one(fillers(X.starts_with_filler), "ohm")
    assert one(X.clean_markup, "&copy;&#233;&nbsp;&hellip; x") == "©é … x"
    assert one(lambda t: X.contains_alias(t, F.lit("Ann")), "see ann!") and not one(lambda t: X.contains_alias(t, F.lit("Ann")), "Annie") and not one(lambda t: X.contains_alias(t, F.lit("A")), "A")
    assert one(lambda t: X.contains_alias(t, F.lit("Ann"), "runtime"), "see ANN.") and not one(lambda t: X.contains_alias(t, F.lit("Ann"), "runtime"), "ann_x") and one(lambda t: X.contains_alias(t, F.lit("É"), "runtime"), "xÉx")
    assert sorted(one(X.ngrams, "水火土x水")) == sorted(["水火", "火土", "水火土"])
    assert one(lambda t: X.count_of(t, F.lit("aa")), "aaaaa") == 2
    assert one(lambda t: X.clean_aliases(t, F.array(F.lit("BAD"))), ["a", "", "bad", "a", "b"], "array<string>") == ["a", "b"]
    assert one(X.prefer_non_ascii, ["a", "é"], "array<string>") == ["é"] and one(X.prefer_non_ascii, ["a"], "array<string>") == ["a"]
    assert one(lambda t: X.safe_trigger(t, ("city",)), "City") is False and one(lambda t: X.safe_trigger(t, ("city",)), "水火")
    assert one(lambda t: X.derived_triggers(F.array(t)), "Fire & Water/Land, Sea") == ["Fire", "Water", "Land", "Sea"]
    assert one(lambda t: X.exact_terms(F.array(t), F.lit("he said “old name” twice"), ("历史",), ("the",)), "水国历史·火") == ["old name", "水国历史·火", "水国"]
    assert one(lambda t: X.content_text(F.parse_json(t)), '[{"type":"text","text":"a"},{"type":"image"}]') == "a\n[image]" and one(lambda t: X.content_text(F.parse_json(t)), '"s"') == "s"
    assert one(lambda t: X.without_block(t, F.lit("be kind")), "be kind\nhello") == "hello"
    assert one(lambda t: X.labelled(t, {"a": "x"}, "y"), "b") == "y"


def test_flags_and_checks(spark):
    rows = spark.createDataFrame([("Ego & Bo", "{X} (Test) hi", ["x discarded"]), ("Ego", " 　", ["(test)"])], "speaker string, text string, meta array<string>")
    flags = [r.f.asDict() for r in rows.select(scenes.line_flags(F.col("speaker"), F.col("text"), F.lit("Ego"), F.col("meta")).alias("f")).collect()]
    assert [k for k, v in flags[0].items() if v] == ["joint_speaker", "contains_markup", "text_test_marker", "discarded_marker"] and [k for k, v in flags[1].items() if v] == ["metadata_test_marker", "empty_text"]
    both = rows.select(scenes.line_flags(F.col("speaker"), F.col("text"), F.lit("Ego"), F.col("meta")).alias("f"))
    assert [r[0] for r in both.select(scenes.pair_exclusions(F.col("f"), F.col("f"), True)).collect()] == [["text_test_marker", "discarded_marker", "joint_speaker"], ["empty_text", "metadata_test_marker"]]
    schema = "id string, facts array<string>, a array<struct<fact_id string, epistemic_status string, response_mode string, evidence_scene_ids array<string>>>, scenes array<string>"
    cards = spark.createDataFrame([("ok", ["f1"], [("f1", "firsthand", "state", ["s1"])], ["s1"]), ("bad", ["f1", "f2"], [("f1", "firsthand", "state", []), ("f3", "unknown", "state", ["s9"])], ["s1"])], schema)
    rules = checks.viewpoint_rules({"firsthand": ("state",), "unknown": ("decline",)}, F.col("facts"), F.col("a"), F.col("scenes"))
    got = checks.violations(cards, "id", rules).collect()
    assert {r.rule for r in got} == {"missing_fact", "foreign_fact", "foreign_scene", "status_and_mode", "firsthand_without_scene"} and {r.id for r in got} == {"bad"}
    reviews = spark.createDataFrame([("a", "pass", [], "t", "t"), ("b", "pass", ["i"], "u", "t"), ("c", "revise", [], "", "t")], "id string, verdict string, issues array<string>, safe_replacement string, text string")
    assert sorted((r.id, r.rule) for r in checks.violations(reviews, "id", checks.review_rules(F.col("text"))).collect()) == [("b", "pass_changes_text"), ("b", "pass_with_issues"), ("c", "revise_without_issues"), ("c", "revise_without_text")]
    keys = checks.nested_keys(spark.createDataFrame([(1, '{"a": {"secret": 1, "b": "x: \\"secret\\""}}')], "id int, j string"), "id", "j", ("secret", "none")).collect()
    assert [r.forbidden for r in keys] == ["secret"]


def test_reports(spark):
    strings = spark.createDataFrame([(i, "x {M#he}{F#she} y {M#he}{F#she}") for i in range(8)], "place int, value string")
    r = reports.branch_inventory(strings, "value", "place").first()
    assert (r.occurrences, r.male, r.female, r.examples) == (16, "he", "she", [0, 1, 2, 3, 4])
    src, rows = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([([1, 2],), ([2],)], "ids array<int>")
    assert tuple(reports.coverage(src, "id", rows, "ids").first()) == (3, 2, 1)
    bad = reports.reconciled(spark.createDataFrame([("f", 2), ("g", 1)], "file string, n int"), spark.createDataFrame([("f",), ("f",)], "file string"), "file").collect()
    assert [(x.file, x.expected, x.found) for x in bad] == [("g", 1, 0)]
    out = reports.bundles(src, "id", {"hits": (spark.createDataFrame([(1, "b"), (1, "a")], "id int, v string"), ["v"])}).orderBy("id").collect()
    assert [x.n_hits for x in out] == [2, 0, 0] and [h.v for h in out[0].hits] == ["a", "b"]


def test_chains_with_cycles(spark):
    rows = [("a", None, "g", "1"), ("b", "a", "g", " 2 "), ("c", "b", "g", ""), ("d", "c", "h", "4"), ("e", "x", "g", "5"), ("f", "e", "g", "6"), ("f2", "e", "g", "7"), ("p", "q", "g", "8"), ("q", "p", "g", "9")]
    got = dialogue.merged_chains(spark.createDataFrame(rows, "id string, before string, gid string, text string"), "id", "before", "gid", "text")
    assert sorted((r.head, r.merged_ids, r.text) for r in got.collect()) == [("a", ["a", "b", "c"], "1\n2"), ("d", ["d"], "4"), ("e", ["e"], "5"), ("f", ["f"], "6"), ("f2", ["f2"], "7"), ("p", ["p"], "8"), ("q", ["q"], "9")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_aliases_inside_sentences_and_between_letters(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "AUTOMATON_ALIASES", most)
    texts = spark.createDataFrame([(1, "我和火神阿贾克斯去了Ann家"), (2, "Annie met ann, ANN; Mary Ann."), (3, "C-3PO and ;-) hi"), (4, "ann_x éA"), (5, None)], "id int, text string")
    names = spark.createDataFrame([("a", "阿贾克斯"), ("b", "Ann"), ("c", "火"), ("d", "Mary Ann"), ("e", "C-3PO"), ("f", ";-)"), ("g", "é")], "who string, alias string")
    got = {(r.id, r.who, r.n) for r in retrieval.alias_matches(texts, "id", "text", names, "who", "alias").collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (2, "b", 3), (2, "d", 1), (3, "e", 1), (3, "f", 1), (4, "b", 1)}
    got = {(r.id, r.who, r.n) for r in retrieval.alias_matches(texts, "id", "text", names, "who", "alias", "runtime").collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "b", 3), (2, "d", 1), (3, "e", 1), (3, "f", 1), (4, "g", 1)}


def test_automaton_and_join_agree(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices(["a", "b", "A", " ", "_", "水", "火", "é", "1", "."], k=n))
    texts = spark.createDataFrame([(i, say(rng.choice([0, 3, 40]))) for i in range(150)] + [(999, None)], "id int, text string")
    names = spark.createDataFrame([(str(i), say(rng.randint(1, 3))) for i in range(120)], "who string, alias string")
    found = {}
    for most in (200_000, 0):
        monkeypatch.setattr(retrieval, "AUTOMATON_ALIASES", most)
        for mode in ("pipeline", "runtime"):
            found[mode, most] = sorted(tuple(r) for r in retrieval.alias_matches(texts, "id", "text", names.where("trim(alias) <> ''"), "who", "alias", mode).collect())
        terms = names.selectExpr("who", "lower(alias) AS alias").where("length(alias) >= 2").distinct()
        found["anywhere", most] = sorted(tuple(r) for r in retrieval.substring_matches(texts, "id", "text", terms, "who", "alias").collect())
    for kind in ("pipeline", "runtime", "anywhere"):
        assert found[kind, 0] == found[kind, 200_000] and len(found[kind, 0]) > 100


def test_matched_cards_and_shadowing():
    met = [("world", "w1", "Sea"), ("world", "w1", "Sea of Fire"), ("world", "w2", "Fire"), ("world", "w3", "Land"), ("relationship", "r2", "Fire"), ("relationship", "r1", "x"), ("character", "c", "y")]
    assert sessions.processed(met) == [("character", "c"), ("relationship", "r1"), ("relationship", "r2"), ("world", "w1"), ("world", "w3")]


def test_pairs_that_cannot_be_among_the_best_are_not_scored(spark, monkeypatch):
    rng = random.Random(15)
    words = [f"word{i}" for i in range(60)]
    texts = spark.createDataFrame([(i, rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([3, 30, 90]))) for i in range(200)], "t int, terms array<string>")
    queries = spark.createDataFrame([(i, rng.sample(words, 4)) for i in range(12)], "q int, terms array<string>")
    exact = spark.createDataFrame([(q, t, 18.0 + 40.0 * rng.random()) for q in range(12) for t in range(200) if rng.random() < 0.5], "q int, t int, term_score double")
    kept, plain = [], retrieval.promising
    monkeypatch.setattr(retrieval, "promising", lambda *a: kept.append(plain(*a)) or kept[-1])
    score = lambda **how: retrieval.lexical_scores(queries, "q", texts, "t", "terms", exact, most_df_share=1, **how)
    best = lambda df: sorted((r.q, r.t, round(r.score, 6), r.rank) for r in retrieval.top_per_key(df, ["q"], [F.desc(F.round("score", 6)), F.col("t")], 5).collect())
    assert best(score()) == best(score(top=5)) == best(score(top=5, blocks=7))
    assert all(k.count() < 0.7 * exact.count() for k in kept[:1]) and len(kept) == 2
    assert kept[0].count() <= kept[1].count()


def test_shadowed_aliases_by_containment(spark):
    from corpuslake.operators.activation import containment, longest_matches

    rng = random.Random(14)
    names = ["".join(rng.choices("ab水", k=rng.randint(1, 5))) for _ in range(40)]
    rows = list({(rng.randint(0, 30), f"c{rng.randint(0, 12)}", rng.choice(names)) for _ in range(400)})
    got = {tuple(r) for r in longest_matches(spark.createDataFrame(rows, "t int, card string, alias string"), "t", "card", "alias").collect()}
    best = {}
    for t, card, alias in rows:
        old = best.setdefault(t, {}).get(card)
        if old is None or (-len(alias.encode()), alias) < (-len(old.encode()), old):
            best[t][card] = alias
    assert got == {(t, c, a) for t, cards in best.items() for c, a in cards.items() if not any(a in b and len(b.encode()) > len(a.encode()) for o, b in cards.items() if o != c)}
    inside = {tuple(r) for r in containment(spark.createDataFrame([(n,) for n in names], "alias string"), "alias").collect()}
    assert inside == {(a, b) for a in names for b in names if a != b and a in b}


def test_compaction_keeps_answers_with_their_questions():
    assert [sessions.kept_messages([{"u": "user", "a": "assistant", "s": "system"}[c] for c in x]) for x in ("uauaua", "uauau", "suaua", "ua", "uuuauaua")] == [4, 5, 4, 2, 4]


def test_splits_of_a_stream_equal_a_walk(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.user_id, r.event_id): (r.compacted, r.kept, r.compactions) for r in suite.QUERIES["compaction_split_stream"](spark, sf).collect()}
    want = {}
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    held, done, user = [], 0, None
    for r in rows:
        if r.user_id != user:
            held, done, user = [], 0, r.user_id
        held.append(("user" if r.event_id % 2 == 0 else "assistant", len(r.props)))
        older = 0
        if sum(n for _, n in held) >= 80 and len(held) >= 3:
            stay = min(len(held) - 1, 5 if held[-1][0] == "user" else 4)
            if held[-stay][0] == "assistant" and stay < len(held) and held[-stay - 1][0] == "user":
                stay += 1
            older = len(held) - stay
            if older > 0:
                held, done = held[-stay:], done + 1
        want[r.user_id, r.event_id] = (max(older, 0), len(held), done)
    assert got == want


def test_scene_without_context_is_an_error(spark):
    words = {"scene": "", "situation": "", "previous": "", "last": "", "choice": "", "someone": "", "colon": ":", "fallback": "f", "close": "c"}
    rows = spark.createDataFrame([("t", [])], "title string, c array<struct<speaker:string,text:string,kind:string>>")
    assert rows.select(sft.scene_prompt(F.col("title"), F.lit(None).cast("string"), F.col("c"), words, {})).first()[0] == "t\nf\nc"
    with pytest.raises(Exception, match="without usable context"):
        rows.select(sft.scene_prompt(F.col("title"), F.lit(""), F.col("c"), words, {}, True)).collect()


def test_ratios_and_global_numbers(spark):
    with pytest.raises(ValueError):
        checks.split_problems(spark.range(3).selectExpr("'a' split"), "split", {"a": 0.7, "b": 0.7}, 0.1)
    rows = numbered(spark.range(500).selectExpr("id % 50 as a", "id"), [F.desc("a"), F.col("id")], "place").collect()
    assert [r.place for r in sorted(rows, key=lambda r: (-r.a, r.id))] == list(range(1, 501))


def test_canonical_rows_without_a_key_stay_alone(spark):
    rows = spark.createDataFrame([("k", "s2", 5), ("k", "s1", 7), (None, "s1", 1), (None, "s1", 2), ("", "s3", 3)], "key string, source string, n int")
    got = dedup.canonical(rows, "key", [F.col("n")], "source").collect()
    assert sorted((str(r.key), r.n, tuple(r.duplicate_sources), r.source_occurrence_count) for r in got) == [("", 3, ("s3",), 1), ("None", 1, ("s1",), 1), ("None", 2, ("s1",), 1), ("k", 5, ("s1", "s2"), 2)]


def test_compaction_of_short_histories(spark):
    from corpuslake.operators.dialogue import compaction_split

    cases = {"aua": 1, "uua": 0, "uuua": 0, "uau": 0, "ua": 0, "suau": 0, "saua": 1, "uuu": 1, "uauaua": 2, "uauauau": 2, "sss": 2}
    names = {"a": "assistant", "u": "user", "s": "system"}
    rows = [(case, i, names[c]) for case in cases for i, c in enumerate(case)]
    got = compaction_split(spark.createDataFrame(rows, "s string, i int, role string"), "s", "i", "role").collect()
    out = {case: sorted(r.i for r in got if r.s == case and r.compacted) for case in cases}

    def plain(case):
        first = case[0] == "s"
        if len(case) - first < 3:
            return []
        keep = 5 if case[-1] == "u" else 4
        start = len(case) - keep if len(case) > first + keep else first + 1
        if case[start] == "a" and case[start - 1] == "u":
            start -= 1
        return list(range(first, start))

    assert out == {case: plain(case) for case in cases}


def test_scenes_without_ids_group_by_the_fallback(spark):
    from pyspark.sql import functions as F

    from corpuslake.operators.dedup import canonical

    rows = spark.createDataFrame([(1, [], "f", "a"), (2, [], "f", "a"), (3, [], "f", "b"), (4, ["x"], "f", "a"), (5, ["x"], "g", "a"), (6, None, "f", "b")], "n int, ids array<string>, file string, scene string")
    pick = lambda *more: sorted((r.n, r.source_occurrence_count) for r in canonical(rows, "ids", [F.col("n")], "file", *more).collect())
    assert pick() == [(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)] and pick(["file", "scene"]) == [(1, 2), (3, 1), (4, 2), (6, 1)]
