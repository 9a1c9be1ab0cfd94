import math
import os

import duckdb
import pandas as pd
import pytest

from corpuslake.plans import sources, suite
from corpuslake.streaming import sessions

SF = "/root/testdata/sf0.001"
#: A selection of each module; the driver compares all queries at a larger size.
NAMES = [
    "norm_text_dedup", "canonical_pick", "align_full", "exclusion_reasons", "length_percentiles", "leakfree_split", "split_leakage", "context_window", "turn_merge", "compaction_split", "lru_active", "lru_stream", "compaction_stream", "lexical_retrieval", "alias_join", "shadowed_matches", "trigger_owners", "relationship_nodes", "review_lineage", "consistency_rules", "token_budget",
    "json_scan", "scene_context", "wikitext_voices", "stored_sessions", "scene_prompts", "line_prompts", "alias_names", "gram_retrieval", "voice_evidence", "answer_rules", "viewpoint_violations", "restored_sets", "activation_stream", "numeric_id_order",
    "compaction_split_stream", "chat_exclusions", "canonical_scenes", "speaker_inventory", "speaker_scenes", "pair_exclusions", "character_totals", "contradictions", "verdict_issues", "evidence_bundles", "rule_categories"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v if isinstance(v, int | bool) or v is None else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = suite.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(suite.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["lru_stream", "compaction_stream", "compaction_split_stream"])
def test_streams_do_not_depend_on_the_order_of_files(spark, db, tmp_path, name):
    """Newest events in the first files, two triggers; rows of a conversation in both."""
    path, rows = f"{tmp_path}/events.parquet", spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    os.mkdir(path)
    for i in range(10):
        file = f"{path}/part-{i}.parquet"
        part = rows.iloc[len(rows) * (9 - i) // 10 : len(rows) * (10 - i) // 10]
        part.sample(frac=1, random_state=i).to_parquet(file, index=False, coerce_timestamps="us")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    df = suite.QUERIES[name](spark, str(tmp_path))
    rel = db.sql(suite.ORACLES[name]).select(", ".join(df.columns))
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_late_turns_are_dropped_and_slots_close_in_order(spark, tmp_path):
    """With a delay, what the watermark has passed comes out at once, and a turn that is later than the delay is left out."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    files = [[(1, 1, at(1), 5), (1, 2, at(0), 5)], [(1, 3, at(10), 5)], [(1, 5, at(9), 5)], [(1, 4, at(2), 100)]]
    for i, rows in enumerate(files):
        file = f"{tmp_path}/in/{i}"
        spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, size long").coalesce(1).write.parquet(file)
    os.mkdir(f"{tmp_path}/all")
    for i in range(4):
        (part,) = [f for f in os.listdir(f"{tmp_path}/in/{i}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/in/{i}/{part}", f"{tmp_path}/all/{i}.parquet")
        os.utime(f"{tmp_path}/all/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    turns = spark.readStream.schema("user_id long, event_id long, ts timestamp, size long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    got = sessions.replay(spark, turns, lambda t: sessions.compactions(t, 10, 0.8, delay="3 hours")).orderBy("n").collect()
    # 4 comes when hour 7 has passed, by the batch before
    assert [(r.event_id, r.n, r.due, r.compactions) for r in got] == [(2, 1, False, 0), (1, 2, True, 1), (5, 3, False, 1), (3, 4, True, 2)]


def test_slots_that_close_together_are_one_call(spark):
    """A call a slot took a stream's time; the conversation below has 90 slots."""
    calls = []

    class State:
        exists, get = False, ()
        timeout = None

        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def update(self, new):
            self.get, self.exists = new, True

    def fold(state, rows):
        calls.append(len(rows))
        return (state[0] + len(rows),), [(r[1], state[0] + i) for i, r in enumerate(rows)]

    rows = pd.DataFrame([(7, None, d * 86_400_000_000 + 5, d) for d in reversed(range(1, 91))], columns=["user_id", "ts", "at", "event_id"])
    step = lambda state, parts: pd.concat(sessions._ordered((7,), parts, state, fold, (0,), ["at", "event_id"], ["user_id", "event_id", "i"], 86_400_000))
    state = State(0)
    assert step(state, [rows[:40], rows[40:]]).empty and state.timeout == 2 * 86_400_000
    state.mark = 61 * 86_400_000 + 1
    assert step(state, []).values.tolist() == [[7, d, d - 1] for d in range(1, 61)]
    state.mark = 1000 * 86_400_000
    assert step(state, []).values.tolist() == [[7, d, d - 1] for d in range(61, 91)] and calls == [60, 30]


def test_pages_equal_their_sql_where_entities_are_cut_or_unknown(spark, tmp_path):
    pages = ["<p>a &amp b &am", "x &hellip; &#233; &amp;lt; &nbsp;y &lt", "a\u00a0b<br>\u00a0c &copy", "<script>1</script>&quot;&#39;&middot;", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = suite.QUERIES["html_clean"](spark, str(tmp_path)).select("page_id", "text_sha")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(suite.ORACLES["html_clean"]).select("page_id, text_sha").fetchall())


@pytest.mark.parametrize("name", ["flag_counts", "triage_flags"])
def test_flags_measure_a_text_once(spark, db, name):
    df = suite.QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert sorted(map(tuple, df.collect())) == sorted(db.sql(suite.ORACLES[name]).select(", ".join(df.columns)).fetchall())


def test_shadowing_reads_the_texts_once(spark):
    assert "regexp_extract_all" not in suite.QUERIES["shadowed_matches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["scan_report", "json_errors", "json_scan", "stored_sessions"])
def test_files_do_not_grow_with_conversations(spark, tmp_path, monkeypatch, name):
    """A file for each of the 400 took the time of these queries."""
    rows = [(i, k, ("system", "user", "assistant")[(i + k) % 3], f"t{i} {k}") for i in range(400) for k in range(1 + i % 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/conversations.parquet")
    monkeypatch.setattr(sources, "shared_folder", lambda _: f"{tmp_path}/shared")
    df, c = suite.QUERIES[name](spark, f"{tmp_path}/in"), duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/in/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(suite.ORACLES[name]).select(", ".join(df.columns)).fetchall())
    assert 0 < sum(len(files) for _, _, files in os.walk(f"{tmp_path}/shared")) < 40


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
