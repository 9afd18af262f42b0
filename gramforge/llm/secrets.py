"""Secret scans [native]: base patterns, and multipart credentials linked by an interval join.

A base span stands alone. Weak candidates (account names, long random-looking tokens, endpoints) are reported only when
complementary parts meet within a scope: a token needs an access identifier or account within SCOPE code points, an
account needs a secret there (a token and an account complete each other), an endpoint needs a secret that is reported
itself: a base one, or a token that was completed. Parts that overlap don't complete one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.llm.runtime import Scratch, stored

SCOPE = 160
#: kind -> (pattern, group whose length counts, least length, role); fixed values of the base kinds
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, "identifier"),
    "hex": (r"[0-9a-f]{16,}", 0, "secret"),
}
#: weak kinds: pattern, role, roles that complete it
WEAK = {
    "account": (r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "identifier", ("secret",)),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}", "secret", ("identifier",)),
    "endpoint": (r"""(?i:https?://[A-Za-z0-9.:/_-]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""", "endpoint", ("secret",)),
}
SPAN = "struct<kind:string,role:string,start:int,end:int,weak:boolean>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
NO_RUNS = f"cast(array() as array<struct<at:int,out:array<{SPAN}>>>)"
#: Matches are gathered in runs of this many, so that a text with many matches doesn't copy a growing array each time.
RUN = 256


def _spans(text: Column, pattern: str, kind: str, role: str, weak: bool, least: int = 0) -> Column:
    """Spans of all matches: what lies between them (split) and the matches themselves give running lengths."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    start_len = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), lambda x: F.char_length(x))
    pairs = F.arrays_zip(start_len.alias("gap"), F.transform(whole, lambda m: F.char_length(m)).alias("len"), whole.alias("m"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["len"]
        span = F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), start.alias("start"), end.alias("end"), F.lit(weak).alias("weak"))
        kept = F.length(F.regexp_extract(p["m"], pattern, 1)) >= least if least else F.lit(True)
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def add_run(acc: Column, run: Column) -> Column:
        begin = F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0)).alias("at"), F.expr(NO_SPANS).alias("out"))
        return F.concat(acc, F.array(F.aggregate(run, begin, add)))

    runs = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: F.slice(p, k * RUN + 1, RUN))
    # a value that is used twice is bound by a transform of one element
    made = F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, F.expr(NO_SPANS)).otherwise(F.aggregate(runs(p), F.expr(NO_RUNS), add_run, lambda acc: F.flatten(F.transform(acc, lambda r: r["out"])))))
    return made[0]


def _found(text: Column) -> Column:
    """All base and weak spans of a text; cheap tests that every match must meet come first."""
    may_assign = text.contains("=") | text.contains(":")
    none = F.expr(NO_SPANS)
    parts = [
        F.when(may_assign, _spans(text, BASE["assign"][0], "assign", "secret", False, BASE["assign"][1])).otherwise(none),
        F.when(text.contains("AKIA"), _spans(text, BASE["access"][0], "access", "identifier", False)).otherwise(none),
        F.when(text.rlike(BASE["hex"][0]), _spans(text, BASE["hex"][0], "hex", "secret", False)).otherwise(none),
        F.when(may_assign, _spans(text, WEAK["account"][0], "account", "identifier", True)).otherwise(none),
        F.when(may_assign, _spans(text, WEAK["endpoint"][0], "endpoint", "endpoint", True)).otherwise(none),
        F.when(text.rlike("[A-Za-z0-9+/_-]{32}"), _spans(text, WEAK["opaque"][0], "opaque", "secret", True)).otherwise(none),
    ]
    return F.concat(*parts)


def _completed(parts: DataFrame, open_: DataFrame, scope: int) -> DataFrame:
    """Of the weak spans open_ (row, kind, start, end): those that one of the parts (row, role, start, end) with a role they
    need ends before, at most `scope` code points away, or starts after. Both meet in a block of `scope` code points,
    which holds few of them."""
    block = lambda c: F.expr(f"{c} div {scope}")
    ends = F.array(F.struct(F.lit("before").alias("side"), F.col("end").alias("pos")), F.struct(F.lit("after").alias("side"), F.col("start").alias("pos")))
    anchors = parts.select("row", "role", F.inline(ends)).withColumn("block", block("pos")).distinct()
    needs = F.create_map(*[x for k, (_, _, roles) in WEAK.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in roles]))])
    reach = F.array(
        F.struct(F.lit("before").alias("side"), F.greatest(F.col("start") - scope, F.lit(0)).alias("lo"), F.col("start").alias("hi")),
        F.struct(F.lit("after").alias("side"), F.col("end").alias("lo"), (F.col("end") + scope).alias("hi")),
    )
    open_ = open_.withColumn("role", F.explode(F.element_at(needs, F.col("kind")))).select("row", "kind", "start", "end", "role", F.inline(reach))
    open_ = open_.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    o, a = open_.alias("o"), anchors.alias("a")
    same = [F.col(f"o.{c}") == F.col(f"a.{c}") for c in ("row", "role", "side", "block")]
    return o.join(a, [*same, F.col("a.pos").between(F.col("o.lo"), F.col("o.hi"))], "left_semi").select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for a row of docs: the id and `found`, an array of spans (kind, role, start, end, weak), code points.

    Null and empty texts have no spans, texts of any length are taken whole, repeated rows have equal spans, an empty table
    gives no rows; columns other than the id and the text are left out. The texts are read once: their spans go to the shared folder, and only rows with
    weak spans take part in the linking.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), _found(text).alias("found")).withColumn("row", F.monotonically_increasing_id()), "found")
    has_weak = F.exists("found", lambda s: s["weak"])
    spans = rows.filter(has_weak).select("row", F.inline("found"))
    # who and what first, where after: an endpoint is completed by what is reported
    ends = spans.filter("kind = 'endpoint'")
    pairs = scratch.keep(_completed(spans.filter("kind <> 'endpoint'"), spans.filter("weak and kind <> 'endpoint'"), scope), "pairs")
    told = spans.filter("not weak").select("row", "role", "start", "end").unionByName(pairs.filter("kind = 'opaque'").select("row", F.lit("secret").alias("role"), "start", "end"))
    linked = pairs.unionByName(_completed(told, ends, scope))
    kept = linked.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("kept"))
    stay = lambda s: ~s["weak"] | F.coalesce(F.array_contains(F.col("kept"), F.struct(s["kind"], s["start"], s["end"])), F.lit(False))
    weak = rows.filter(has_weak).join(kept, "row", "left").select("id", F.filter("found", stay).alias("found"))
    out = stored(rows.filter(~has_weak).select("id", "found").union(weak).select(F.col("id").alias(id_col), "found"), "secrets")
    scratch.remove()
    return out


def span_digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate([*BASE, *WEAK]) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(order, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["c"].cast("string"))), ",")
