"""Fits where all texts of a class or language are long, scores of long texts by windows, endpoints beside weak tokens."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramforge.llm import language, quality, secrets

GOOD, BAD = "The quiet river runs past old mills and gardens where people rest. ", "x9$$ zz## click!! click!! "


def test_quality_of_long_texts_only(spark):
    """All labelled texts are longer than a piece; the classes are told apart all the same."""
    rows = [(i, (GOOD if i % 2 else BAD) * 400 + str(i)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    network = quality.train(docs, labels)
    got = quality.score_quality(docs, network).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_quality_fit_draws_from_rows_with_texts(spark, monkeypatch):
    """Labels of ids without a text take no place from others."""
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, texts, labels: seen.append(sorted(labels)) or self)
    docs = spark.createDataFrame([(i, "a text") for i in range(50)] + [(None, "b"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    quality.train(docs, labels, rows=12)
    assert seen == [[0] * 12 + [1] * 12]


@pytest.mark.parametrize("size", [1 << 12, (1 << 12) + 1, 9000, 123_457])
def test_windows_score_as_the_whole(monkeypatch, size):
    g = np.random.default_rng(size)
    text = bytes(g.integers(32, 127, size, dtype=np.uint8)).decode() if size % 2 else ("ab cd " * size)[:size]
    texts = pa.array([text, "short", ""])
    network = quality.Network()
    want = network.scores(texts)
    monkeypatch.setattr(quality, "SLICE", 1 << 10)
    assert np.allclose(network.scores(texts), want, rtol=1e-6, atol=0)


def test_language_of_long_texts_only(spark):
    """A language whose texts are all long is learned from pieces of them, one that repeats a row very often as well."""
    german = "der Hund und die Katze gehen nicht über die Straße weil es regnet "
    rows = [(i, german * 150 + str(i), "de") for i in range(60)] + [(i, "the dog and the cat don't cross the road because of rain " * 3 + str(i), "en") for i in range(60, 120)]
    rows += [(200, "le chien et le chat ne traversent pas la rue", "fr")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs)).collect()
    want = {r[0]: r[2] for r in rows}
    assert {r.lang_pred for r in got} == {"de", "en", "fr"} and all(r.lang_pred == want[r.doc_id] for r in got)


TOKEN = "Ab1" * 12


@pytest.mark.parametrize(
    "text, kinds",
    [
        (f"https://example.com/a and then https://files.example.org/{TOKEN}", set()),
        (f"see https://example.com/build {TOKEN}", set()),
        (f"user=bob42 {TOKEN}", {"account", "opaque"}),
        (f"https://example.com/a user=bob42 {TOKEN}", {"account", "opaque", "endpoint"}),
        ("https://example.com/a password=abcdefgh12345", {"assign", "endpoint"}),
    ],
)
def test_endpoints_need_reported_secrets(spark, text, kinds):
    found = secrets.find_secrets(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).filter("doc_id = 1").first().found
    assert {s.kind for s in found} == kinds


def test_texts_longer_than_a_piece(spark):
    """Texts of three million bytes, beyond the pieces of all operators, with what is looked for at their ends."""
    from tokenizers import Tokenizer

    from gramforge.llm import decontam, fingerprints, neardup, pii, tokens
    from gramforge.llm.bytescan import SLICE_BYTES

    g = np.random.default_rng(9)
    words = ["".join(chr(97 + int(c)) for c in g.integers(0, 26, int(n))) for n in g.integers(2, 9, 4000)]
    passage = " ".join(words[int(k)] for k in g.integers(0, 4000, 30))
    body = " ".join(words[int(k)] for k in g.integers(0, 4000, 520_000))
    long = f"{body} {passage} mail a.person@example.org password=abcdefABCDEF1234"
    near = long.replace(body[:200], "something else", 1)
    assert len(long) > SLICE_BYTES + (1 << 19)
    docs = spark.createDataFrame([(1, long, "en"), (2, near, "en"), (3, "short and sweet", "en"), (4, None, None)], "doc_id long, text string, lang string").repartition(1)
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in found} == {(1, 7, 1.0), (2, 7, 1.0)}
    assert {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    spans = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert spans[1].n_email == 1 and f"email:{long.index('a.person')}:{long.index('a.person') + 20}" in spans[1].spans
    secret = {r.doc_id: {(s.kind, s.start) for s in r.found} for r in secrets.find_secrets(docs).collect()}
    assert ("assign", long.index("password")) in secret[1] and not secret[3]
    assert language.identify(docs, language.train(docs, rows=5)).filter("doc_id < 4").select("lang_pred").distinct().collect()[0][0] == "en"
    prints = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    assert prints[1].n_chars == len(long) and prints[1].near_next > 0.9 and prints[2].near_next < 0.1
    encoder = Tokenizer.from_file(tokens.word_bpe_path())
    counts = {r.doc_id: r.n_tokens for r in tokens.tokenize(docs).collect()}
    assert counts[1] == len(encoder.encode(long, add_special_tokens=False).ids) + 1 and counts[4] == 1
