"""Operator 6: a quality classifier by Bradley-Terry pairwise ranking.

Features of a text (symbol, case, repetition, line and word statistics) are computed from its
bytes, each spread over bins learned as quantiles.  Preference pairs are (document of quality
1, document of quality 0); the probability that the first is preferred is the logistic function
of the difference of their scores, and the weights minimise the logistic loss of feature
differences.  A document counts as good if its score lies above the quantile of the scores of
the learning rows that matches their share of quality 0.

The weights are learned from at most ``MAX_ROWS`` labelled rows of each quality (those with the
smallest hash of their doc_id), so the fit on the driver is bounded; every document is scored in
the tasks, and the quantile and the share are those of all learning rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm import textvec
from boxlens.llm.langid import fold
from boxlens.session import pin, release

MAX_ROWS = 20_000          # learning rows of each quality
PAIRS = 30_000             # preference pairs drawn from them
BINS = 8
CELLS = 1024               # ranges of scores counted at a time for the threshold
RIDGE = 1e-3
_TABLE = textvec.byte_table("nonspace")
NAMES = ("log_words", "word_len", "upper", "digit", "symbol", "pipe", "punct", "high", "space", "distinct", "top_word", "adjacent",
         "plain_words", "symbol_words", "upper_words", "lines", "distinct_lines", "words_a_line", "repeat_pairs", "longest_word",
         "symbol_tail", "upper_tail", "adjacent_tail", "sentences")


def _class_counts(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(table[data[off[0]:off[-1]]], dtype=np.int64)])
    rel = off - off[0]
    return c[rel[1:]] - c[rel[:-1]]


def _bytes(chars) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_UPPER = _bytes(range(65, 91))
_DIGIT = _bytes(range(48, 58))
_SYMBOL = _bytes(b"#$%&*<=>@[]^_`{|}~\\+/!")
_PIPE = _bytes(b"|")
_PUNCT = _bytes(b".,;:!?")
_STOP = _bytes(b".!?")
_HIGH = _bytes(range(128, 256))
_SPACE = _bytes([32, 9, 10, 11, 12, 13])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _counts_within(values: np.ndarray, group_off: np.ndarray):
    """Per group: (distinct values, count of the most frequent value)."""
    n = np.diff(group_off)
    g = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, g))
    v, gg = values[order], g[order]
    head = np.ones(len(v), bool)
    head[1:] = (v[1:] != v[:-1]) | (gg[1:] != gg[:-1])
    at = np.flatnonzero(head)
    run = np.diff(np.concatenate([at, [len(v)]]))
    distinct = np.bincount(gg[at], minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, gg[at], run)
    return distinct, top


def _per_group(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, features) of consecutive texts."""
    raw = data[off[0]:off[-1]]
    m, s, e, woff = textvec.words(data, off, _TABLE)
    h = textvec.hash_words(m, s, e)
    n = np.diff(woff)
    nw, nb = np.maximum(n, 1), np.maximum(np.diff(off), 1)
    size = e - s
    cnt = {k: _class_counts(data, off, t) for k, t in (("upper", _UPPER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("pipe", _PIPE),
                                                       ("punct", _PUNCT), ("high", _HIGH), ("space", _SPACE), ("stop", _STOP))}
    distinct, top = _counts_within(h, woff)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[woff[:-1][n > 0]] = False
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = textvec.mix64(h[1:] + h[:-1] * np.uint64(3))
    pair_distinct, _ = _counts_within(pair, woff)
    csum = {k: np.concatenate([[0], np.cumsum(t[raw], dtype=np.int64)]) for k, t in (("symbol", _SYMBOL), ("upper", _UPPER))}
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
    w_symbol = csum["symbol"][e] - csum["symbol"][s]
    w_upper = csum["upper"][e] - csum["upper"][s]
    w_letters = letters[e] - letters[s]
    is_symbol, is_upper, is_plain = w_symbol > 0, (w_upper >= 2) & (2 * w_upper > w_letters), w_letters == size
    # the second half of the words, where a good start may turn bad
    half = np.arange(len(h)) >= np.repeat(woff[:-1] + n // 2, n)
    nh = np.maximum(n - n // 2, 1)
    # lines by the hash of their words
    rel = off - off[0]
    nl_at = np.flatnonzero(raw == 10)
    text_of = np.searchsorted(rel, nl_at, side="right") - 1
    starts = np.concatenate([rel[:-1], nl_at + 1])
    order = np.lexsort((starts, np.concatenate([np.arange(len(n)), text_of])))
    line_of_word = np.searchsorted(starts[order], s, side="right") - 1
    lines = np.bincount(text_of, minlength=len(n)) + 1
    loff = np.concatenate([[0], np.cumsum(lines)])
    word_off = np.searchsorted(line_of_word, np.arange(loff[-1] + 1))
    lh, _ = textvec.sequence_hash(h, word_off)
    distinct_lines, _ = _counts_within(lh, loff)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(n)), n), size)
    cols = (np.log1p(n), (nb - cnt["space"]) / nw, cnt["upper"] / nb, cnt["digit"] / nb, cnt["symbol"] / nb, cnt["pipe"] / nb, cnt["punct"] / nb,
            cnt["high"] / nb, cnt["space"] / nb, distinct / nw, top / nw, _per_group(same, woff) / nw, _per_group(is_plain, woff) / nw,
            _per_group(is_symbol, woff) / nw, _per_group(is_upper, woff) / nw, np.log1p(lines), distinct_lines / lines, n / lines,
            1 - pair_distinct / nw, np.log1p(longest), _per_group(is_symbol & half, woff) / nh, _per_group(is_upper & half, woff) / nh,
            _per_group(same & half, woff) / nh, cnt["stop"] / nw)
    out = np.stack([np.asarray(c, np.float64) for c in cols], axis=1)
    out[n == 0] = 0.0
    return out


def _extract(batches):
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        ids = b.column("doc_id")
        for i, j in textvec.slices(off):
            x = features(data, off[i:j + 1]).astype(np.float32)
            k = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * k, pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])


def spread(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Features as 0/1 columns: value above each cut point (a step function per feature)."""
    return np.concatenate([x[:, [k]] > c[None, :] for k, c in enumerate(cuts)], axis=1).astype(np.float64)


def learn(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Bradley-Terry weights from preferences good over bad, and the score threshold."""
    both = np.concatenate([good, bad])
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.concatenate([np.quantile(both[:, k], q), np.quantile(bad[:, k], q)])) for k in range(both.shape[1])]
    g, b = spread(good, cuts), spread(bad, cuts)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(g) * len(b) * 4)
    gi, bi = rng.integers(0, len(g), n), rng.integers(0, len(b), n)
    w = np.zeros(g.shape[1])
    for _ in range(8):                       # Newton steps on the logistic loss of differences
        grad, hess = RIDGE * n * w, RIDGE * n * np.eye(len(w))
        for s in range(0, n, 20_000):
            d = g[gi[s:s + 20_000]] - b[bi[s:s + 20_000]]
            p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -40, 40)))
            grad -= d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.concatenate([g @ w, b @ w])
    return {"cuts": cuts, "w": w, "threshold": float(np.quantile(scores, len(b) / len(scores)))}


def _raw_scores(model_bc):
    def raw(batches):
        m = model_bc.value
        for b in batches:
            x = np.frombuffer(b.column("x").flatten().to_numpy(zero_copy_only=False), np.float32).reshape(b.num_rows, -1).astype(np.float64)
            s = spread(x, m["cuts"]) @ m["w"] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "raw"])
    return raw


def _threshold(scores: DataFrame, share: float) -> float:
    """The value below which ``share`` of the column raw lies, between neighbours as np.quantile
    has it.  The scores are looked at by ranges, a count per range, so neither the driver
    nor a task holds them, however many are equal."""
    n = scores.count()
    at = share * (n - 1)
    low = min(int(at), n - 1)

    def nth(k: int) -> float:
        lo, hi = scores.agg(F.min("raw"), F.max("raw")).first()
        while lo < hi:
            cell = F.least(F.floor((F.col("raw") - lo) * (CELLS / (hi - lo))), F.lit(CELLS - 1))
            for r in (scores.filter(F.col("raw").between(lo, hi)).groupBy(cell.alias("c"))
                            .agg(F.count("*").alias("n"), F.min("raw").alias("a"), F.max("raw").alias("b")).orderBy("c").collect()):
                if k < r["n"]:
                    break
                k -= r["n"]
            lo, hi = r["a"], r["b"]
        return lo
    a = nth(low)
    b = nth(low + 1) if at > low else a
    return a + (b - a) * (at - low)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, pairs: int = PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality) teaches only by rows of crc32(doc_id) mod 3 other than 1 with
    quality 0 or 1; conflicting or repeated label rows each count.  Null and empty texts have all
    features 0 and a score like others.  If either quality has no learning row, every score is
    0.5.  score lies in 0 to 1, 0.5 at the learned threshold; predicted is 1 from there on; ties
    get equal scores.  labels, lang, source and doc_id are never inputs of a score."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    feats = pin(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                    .mapInArrow(_extract, f"doc_id {kind}, x array<float>"))
    known = (labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
                   .filter((fold(F.col("doc_id")) != 1) & F.col("quality").isin(0, 1)).join(feats, "doc_id"))
    known = pin(known)
    rows = {}
    for q in (1, 0):
        r = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("x").toArrow()
        rows[q] = np.array(r["x"].to_pylist(), np.float64)
    held = (fold(F.col("doc_id")) == 1).alias("held_out")
    if not len(rows[0]) or not len(rows[1]):
        return feats.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    model = spark.sparkContext.broadcast(learn(rows[1], rows[0], pairs))
    taught = pin(known.select("quality", "doc_id", "x").mapInArrow(_raw_scores(model), f"doc_id {kind}, raw double"))
    bad = known.filter("quality = 0").count()
    threshold = _threshold(taught, bad / taught.count())
    release(taught, known)
    raw = feats.mapInArrow(_raw_scores(model), f"doc_id {kind}, raw double")
    bound = F.greatest(F.least(F.col("raw") - F.lit(threshold), F.lit(40.0)), F.lit(-40.0))
    scored = raw.select("doc_id", (1.0 / (1.0 + F.exp(-bound))).alias("score"))
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
