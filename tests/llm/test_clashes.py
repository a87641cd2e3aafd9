"""Every operator beside columns that have the names of its helpers, whatever their case."""

import pytest

from asofkit.llm import ann, fingerprints, langid, linededup, mixing, ngramjoin, packing, queries, sitetree, token_store, warc

NAMES = (
    "k t n h g q v u id th node short rare often share comp list hub code w value key probe first line size part token place held rest d b m o x label record sha path"
    " _host _host_ _site _low _kept _kept_ _kept_hash _kept_key _text_hash _text_hash_ _again _mix_source _mix_source_ _copies _copies_ _K _Host"
).split()
TEXT = "the cat and the dog went over the long road to the town"
ROWS = [(1, TEXT, "a", "en"), (2, TEXT + " again", "a", "en"), (3, "der Hund und die Katze gehen heute in die Stadt\nnoch eine Zeile", "b", "de"), (4, None, None, None), (5, "", "b", "de"), (None, "x", "a", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string, lang string")


def crowded(df):
    have = {c.lower() for c in df.columns}
    seen, extra = set(have), []
    for i, c in enumerate(NAMES):
        if c.lower() not in seen:
            seen.add(c.lower())
            extra.append(f"{i} as `{c}`")
    return df.selectExpr("*", *extra)


OPERATORS = {
    "mix_to_weights": lambda d: mixing.mix_to_weights(d, {"a": 1.0}, total=12.0),
    "dedup_lines": lambda d: linededup.dedup_lines(d),
    "similar_components": lambda d: ngramjoin.similar_components(d),
    "keep_one_of_each": lambda d: ngramjoin.keep_one_of_each(d),
    "identify": lambda d: langid.identify(d),
    "fingerprint_edits": lambda d: fingerprints.fingerprint_edits(d),
    "pack": lambda d: packing.pack(d, queries.tokenizer()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    plain, full = OPERATORS[name](docs), OPERATORS[name](crowded(docs))
    own = [c for c in plain.columns if c != "sequence_id"]
    assert sorted(map(str, full.select(*own).collect())) == sorted(map(str, plain.select(*own).collect()))
    carried = [c for c in full.columns if c not in plain.columns]
    assert all(r[c] == NAMES.index(c) for r in full.collect() for c in carried)


def test_token_files(spark, docs, tmp_path):
    got = []
    for i, d in enumerate((docs, crowded(docs))):
        token_store.write_tokens(d, str(tmp_path / str(i)), queries.tokenizer())
        got.append(sorted(map(str, token_store.token_index(spark, str(tmp_path / str(i))).collect())))
    assert got[0] == got[1] and len(got[0]) == len(ROWS)


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>x"), (3, None, None), (None, "b", "")], "page_id bigint, url string, html string")
    plain, full = sitetree.extract_text(pages), sitetree.extract_text(crowded(pages))
    assert sorted(map(str, full.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    got = []
    for i, d in enumerate((pages, crowded(pages))):
        warc.write_arc(d, str(tmp_path / f"arc{i}"))
        warc.arc_to_warc(spark, str(tmp_path / f"arc{i}"), str(tmp_path / f"warc{i}"))
        rows = warc.read_archives(spark, str(tmp_path / f"warc{i}"))
        got.append(sorted(map(str, rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    assert got[0] == got[1] and len(got[0]) == 4


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i), 1.0]) for i in range(60)], "vec_id bigint, embedding array<double>")
    plain, full = ann.nearest(rows, every=20), ann.nearest(crowded(rows), every=20)
    assert sorted(map(str, full.collect())) == sorted(map(str, plain.collect())) and plain.count() == 30


def test_intermediates_go(spark, docs, tmp_path):
    """What an operator wrote and its result doesn't read is gone once it returns."""
    from asofkit.llm import common

    before = set(common._ours)
    linededup.dedup_lines(docs).collect()
    left = [p for _, p in set(common._ours) - before]
    assert all(p.rsplit("/", 1)[1] in ("first_lines", "later_lines") for p in left) and len(left) <= 2
