"""Operator 5: secret scans with multipart credential linking.

Strong parts are reported as they are: assigned secrets, access identifiers and long hex runs.
Weak parts mean nothing alone: bare mixed tokens, identifiers (user names, client ids) and
endpoints.  An interval join within a scope of ``SCOPE`` characters links parts of one document:

* a weak identifier is reported if a secret (assigned, hex or weak token) lies in its scope,
* a weak token if an identifier (access or weak) does,
* an endpoint if both do;

weak parts that overlap a strong one are dropped, the strong one stays.

Everything is DataFrame functions.  One pass over the texts leaves only the lengths around each
match; positions are running sums of them, and the joins are equi-joins on (row, scope bucket)
with the distance as a condition, so one document of very many parts spreads over many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import pin

SCOPE = 200
#: kind -> (expression for what precedes the counted part, the counted part, its least length)
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    "access": ("", r"AKIA[A-Z0-9]+", 18),
    "hex": ("", r"[0-9a-f]{16,}", 16),       # the maximal runs that are long enough
    "ident": (r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9_.@-]+", 3),
    "token": ("", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])", 24),
    "endpoint": ("", r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>,;]+""", 10),
}
BASE = ("assign", "access", "hex")
_MARK = "\u0001\u0002\u0003"


def _matches(text: Column, before: str, part: str) -> Column:
    """array<struct<skip, head, body>>: for every match, the characters since the previous match,
    and the lengths of its two pieces.  Control characters 1 to 3 mark the pieces; those of the
    text itself are replaced by one other character first."""
    marked = F.regexp_replace(F.translate(text, _MARK, "�" * 3), f"({before})({part})", "\u0003$1\u0002$2\u0001")
    # "gap \3 head \2 body \1 gap \3 head \2 body \1 rest"
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.instr(x, "\u0003") > 0)

    def lengths(x):
        a, b = F.instr(x, "\u0003"), F.instr(x, "\u0002")
        return F.struct((a - 1).alias("skip"), (b - a - 1).alias("head"), (F.length(x) - b).alias("body"))
    return F.when(F.regexp_like(text, F.lit(before + part)), F.transform(parts, lengths))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (rid, doc_id), a row per row of ``docs``, pinned; spans (rid, kind, no,
    start, end) of every match long enough, weak ones included; end is exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = pin(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), *[
        _matches(text, before, part).alias(kind) for kind, (before, part, _) in KINDS.items()]))
    spans = None
    for no, (kind, (_, _, least)) in enumerate(KINDS.items()):
        e = found.filter(F.col(kind).isNotNull()).select("rid", F.posexplode(kind).alias("i", "m"))
        upto = F.sum(F.col("m.skip") + F.col("m.head") + F.col("m.body")).over(Window.partitionBy("rid").orderBy("i"))
        one = (e.select("rid", "m", upto.alias("end")).filter(F.col("m.body") >= least)
                .select("rid", F.lit(kind).alias("kind"), F.lit(no).alias("no"), (F.col("end") - F.col("m.head") - F.col("m.body")).alias("start"), "end"))
        spans = one if spans is None else spans.unionByName(one)
    return found.select("rid", "doc_id"), pin(spans)


def _near(weak: DataFrame, strong: DataFrame, scope: int, how: str) -> DataFrame:
    """Rows of ``weak`` that have (left_semi) or lack (left_anti) a row of ``strong`` in the same
    document at most ``scope`` characters away (-1: overlapping)."""
    def buckets(reach: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE)))
    s = strong.select(F.col("rid").alias("_rid"), F.col("start").alias("_s"), F.col("end").alias("_e"), buckets(max(scope, 0)).alias("_b"))
    w = weak.select("rid", "no", "start", "end", buckets(0).alias("_wb"))
    near = (F.col("_s") - F.col("end") <= scope) & (F.col("start") - F.col("_e") <= scope)
    hit = (w.join(s.hint("merge"), (F.col("rid") == F.col("_rid")) & (F.col("_wb") == F.col("_b")) & near, "left_semi")
            .select("rid", "no", "start").distinct())
    return weak.join(hit.hint("merge"), ["rid", "no", "start"], how)


def linked_weak(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans with their complementary parts in scope."""
    base = spans.filter(F.col("kind").isin(*BASE))
    weak = pin(_near(spans.filter(~F.col("kind").isin(*BASE)), base, -1, "left_anti"))
    secret = base.filter("kind IN ('assign', 'hex')").unionByName(weak.filter("kind = 'token'"))
    ident = base.filter("kind = 'access'").unionByName(weak.filter("kind = 'ident'"))
    out = (_near(weak.filter("kind = 'ident'"), secret, scope, "left_semi")
           .unionByName(_near(weak.filter("kind = 'token'"), ident, scope, "left_semi"))
           .unionByName(_near(_near(weak.filter("kind = 'endpoint'"), secret, scope, "left_semi"), ident, scope, "left_semi")))
    return out


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256
    (of the strong spans as kind:start:end, by start, then kind, comma-joined), spans (all
    reported spans likewise), n_linked (weak spans reported).

    Positions are code points, end exclusive; null text is empty; matches of a kind are leftmost
    and do not overlap, too short ones are dropped after matching.  Repeated rows are reported
    each; other columns are ignored."""
    rows, spans = find_spans(docs)
    reported = spans.filter(F.col("kind").isin(*BASE)).unionByName(linked_weak(spans, scope))
    item = F.struct("start", "no", "end", "kind")
    per = reported.groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"),
                                      *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE])

    def joined(items):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    every = F.coalesce("all", none)
    base = F.filter(every, lambda x: x["no"] < len(BASE))
    # spans grow with the documents: no broadcast while they are few
    return rows.join(per.hint("merge"), "rid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
        (F.size(every) - F.size(base)).cast("long").alias("n_linked"))
