"""One very long text through every operator on documents."""

import pytest

from corpuslake.llm import decontaminate, language_id, licenses, line_dedup, mixing, near_dedup, secrets, suffix_dedup, surrogates

WORDS = 300_000


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 7919}" for i in range(WORDS))
    plain = "a" * 1_500_000
    dotted = "x@" + "a." * 400_000 + "b"
    lines = "\n".join(["the very same line again"] * 50_000)
    return spark.createDataFrame([(1, long, "en", "s"), (2, plain, "en", "s"), (3, dotted, "en", "s"), (4, lines, "en", "s"), (5, long[: len(long) // 2], "en", None), (6, "short one", "en", "s")], "doc_id long, text string, lang string, source string").repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts(spark, docs):
    assert by_id(surrogates.pseudonymize(docs)[0])[1].text.startswith("w0 w1")
    assert len(by_id(licenses.find_licenses(docs)[0])) == 6
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, item))
    assert found[1].n_words == WORDS and found[1].n_hit == 20 * -(-WORDS // 7919) - (20 - min(20, WORDS % 7919)) and found[6].n_hit == 0
    assert by_id(mixing.allocate(docs))[1].size == WORDS
    assert len(by_id(secrets.find_secrets(docs)[0])) == 6
    near = by_id(near_dedup.near_duplicates(docs, 4))
    assert near[1].n_shingles == 7919 and near[5].component_id == 1
    out, names = line_dedup.drop_shared_lines(docs)
    assert by_id(out)[4][names["n_lines"]] == 50_000
    assert by_id(language_id.identify(docs, language_id.train(docs))[0])[2].lang_pred == "en"
    cut = by_id(suffix_dedup.repeated_bytes(docs))
    assert cut[2].n_removed == 1_500_000 and cut[2].n_spans == 1 and cut[6].n_removed == 0 and cut[5].n_removed == cut[5].n_bytes
