"""Merkle manifest, filter audit and HTML extraction: brute force, the DuckDB texts, held-out layouts, odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.llm import audit, html, merkle, queries
from gramforge.llm.runtime import Scratch

SF = "/root/testdata/sf0.001"
LONG = "Long text\n" * 300_000  # beyond the slices of every operator
ODD = [
    (1, None, "en", None, 0),
    (2, "", None, "a", None),
    (None, "x y z\n", "en", "a", 5),
    (3, "a b\nc $", "en", "b", 1),
    (3, "a b\nc $", "en", "b", 1),
    (3, "a b\nd", "en", "b", 1),
    (4, LONG, "en", "b", 1),
    (5, "ÄÖ é 漢字\n🙂", "de", "ü", 1),
    (8, "", "de", "", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("t", "k", "key", "leaf", "other", "m", "pos", "part", "fails", "good", "i", "digest", "u", "h", "n_chars2")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            run = k // 3 * 3
            out.append((level[run:k], level[k + 1 : run + 3]))
            k //= 3
        return out

    def leaf(r, text):
        return sha("".join(part(x) for x in (r[0], r[3], r[2], r[4], text)))

    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = {}, {}
    for s in order:
        own[s] = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in own[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, r in enumerate(own[s]):
            steps = path(trees[s], k) + path(top, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            for left, right in steps:
                h = sha("".join(left) + h + "".join(right))
            out.append((r[0], trees[s][0][k], trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


@pytest.mark.parametrize("depth, top", [(7, 3**9), (1, 9), (2, 3)])
def test_manifest(spark, odd, depth, top):
    """Small blocks and tops go through layers, and through a tree of subroots that the driver doesn't see."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.col("source")).alias("source"), "n_chars")
    for table in (odd, many):
        rows = list(map(tuple, table.select("doc_id", "text", "lang", "source", "n_chars").collect()))
        got = merkle.manifest(table, tampered(), depth=depth, top=top)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_empty_and_one(spark, odd):
    assert merkle.manifest(odd.limit(0), tampered()).count() == 0
    one = merkle.manifest(odd.filter("doc_id = 5"), tampered()).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    # without tampering everything is verified
    assert merkle.manifest(odd).filter("not verified").count() == 0


def brute_audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    seen: dict = {}
    for r in rows:
        if r[0] is not None:
            seen[r[1] or ""] = min(r[0], seen.get(r[1] or "", r[0]))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    marked = []
    for i, text, part in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and t in seen and seen[t] < i)
        marked.append((part or "", fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {m[0] for m in marked}:
            left = [m for m in marked if m[0] == part]
            for step, c in enumerate(order, 1):
                gone = [m for m in left if c in m[1]]
                failing = [m for m in marked if m[0] == part and c in m[1]]
                left = [m for m in left if c not in m[1]]
                shapley[part, c] += len(gone)
                out.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(m[1] == c for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_audit_odd(spark, odd):
    """Null and equal texts and ids, an id with two labels, a label of no row, labels that are null."""
    labels = [(3, 1, 0), (3, 0, 1), (99, 1, 1), (None, 1, 1), (4, None, None), (2, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = audit.filter_interactions(odd, table)
    rows = list(map(tuple, odd.select("doc_id", "text", "lang").collect()))
    want = brute_audit(rows, [x for x in labels if x[0] is not None])
    assert sorted(map(tuple, got.collect())) == want
    assert audit.filter_interactions(odd.limit(0), table).count() == 0


def test_audit_of_other_filters(spark):
    """Two filters of three rows; a filter too many is an error."""
    rows = spark.createDataFrame([("", 1, True, False), ("", 3, False, True), ("", 0, True, True)], "part string, fails int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(rows, ["X", "Y"], Scratch(spark, "audit")).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 0, 1, 1), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        audit.audit(rows, list("ABCDEFGH"), Scratch(spark, "audit"))


@pytest.mark.parametrize("name", ["op11_manifest", "op12_filter_audit"])
def test_oracles(spark, con, name):
    found = queries.QUERIES[name](spark, SF)
    order = sorted(found.columns)
    want = con.sql(f"select {', '.join(order)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(*order).collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def trees(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def plain(page: str) -> str:
    """What the template of the given pages has as its article, by regular expressions."""
    m = re.search(r"<article>(.*)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    blocks = [" ".join(html.references.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(b for b in blocks if b)


def test_html_given_pages(spark, trees):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = html.extract(pages, trees).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_other_layouts(spark, trees):
    """Layouts that the fit hasn't seen, of other pages' blocks: nearly all nodes, and most pages in whole."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    stock = [x.split("\n\n") for x in html.main_texts(trees, pages) if x]
    spare = [html.references.escape(b) for s in stock for b in s]
    g, nodes = np.random.Generator(np.random.PCG64(77)), html.Nodes()
    for s in stock * 4:
        nodes.read(html._layout(g, " ".join(s[0].split()[:9]), [html.references.escape(b) for b in s[:12]], spare))
    a = nodes.arrays()
    main = html.decode(trees.logits(html.features(a)), a["parent"], a["depth"])
    want = a["label"] == 1
    same = np.mean([html._blocks(runs, main) == html._blocks(runs, want) for runs in nodes.pages])
    assert (main == want).mean() > 0.98 and same > 0.85


def test_decode_is_the_best_labelling():
    """Against all labellings of small trees; no main node stands below an excluded one."""
    g = np.random.default_rng(5)
    for _ in range(60):
        n = int(g.integers(1, 8))
        parent = np.array([-1] + [int(g.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        logit = g.normal(0, 2, n)

        def worth(state):
            total = -html.ENTER if state[0] == 1 else (0 if state[0] == 0 else -1e9)
            for k in range(n):
                total += logit[k] if state[k] == 1 else 0
                if k:
                    step = (state[parent[k]], state[k])
                    total -= {(0, 0): 0, (0, 1): html.ENTER, (1, 1): 0, (1, 2): html.LEAVE, (2, 2): 0}.get(step, 1e9)
            return total

        best = max(worth(s) for s in np.ndindex(*[3] * n))
        main = html.decode(logit, parent, depth)
        state = np.zeros(n, int)
        for k in range(n):
            over = state[parent[k]] if k else 0
            state[k] = 1 if main[k] else (2 if over else 0)
        assert worth(state) == pytest.approx(best)


def test_html_odd_pages(spark, trees):
    body = "".join(f"<p>Some words, and more of them; sentence {k} ends here.</p>" for k in range(4))
    cases = {
        1: (None, ""),
        2: ("", ""),
        3: (f"<article><h1>A &amp; B</h1><p>one<br>two&nbsp;&#x41;{body}<script>if (a</p>b) '</article>'</script><!-- <p>no</p> --><div class=ad>Buy</div></article>", None),
        4: ("<article><p class='a>b\">unclosed " + "<div>" * 3000 + "deep", None),
        5: ("</p></div><<>>< a<div data-y=no>", None),
        6: ("<article>" + "<p>word word, word.</p>" * 150_000 + "</article>", "\n\n".join(["word word, word."] * 150_000)),
    }
    rows = [(k, None if k == 2 else f"u{k}", h) for k, (h, _) in cases.items()] + [(1, "u1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "i", "u", "h", "t")})
    got = html.extract(pages, trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {r.page_id: r.text for r in got.collect()}
    for k, (_, want) in cases.items():
        assert want is None or texts[k] == want
    assert texts[3].startswith("A & B\n\none two A\n\nSome words") and "Buy" not in texts[3] and "no" not in texts[3].split() and "if" not in texts[3]
    assert got.count() == 7 and html.extract(pages.limit(0), trees).count() == 0
    assert html.train(pages.limit(0)).logits(np.zeros((1, 80), np.float32)).shape == (1,)
