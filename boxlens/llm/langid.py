"""Operator 1: language identification with interpolated Kneser-Ney character language models.

One model per learned language, order 5, over lower-cased letters (every run of other
characters is one space).  An n-gram is a 60-bit key of five 12-bit characters; the models
live in sorted hash arrays, one per order, holding for every n-gram its log-probability and its
back-off weight in each language.  A text goes to the language of the lowest cross-entropy per
character.

Rows whose crc32(doc_id) mod 3 is 0 give the n-gram counts, rows with 2 the calibration, rows
with 1 are held out.  Counting is a distributed aggregation over all of the first, and every count
is used: a model of more than ``MAX_ENTRIES`` is cut into blocks by the third and fourth
character, which hold whatever scores a 5-gram with these two, and the texts are scored in one pass
for every block, so what is sent to the tasks at once is bounded whatever the corpus.
Calibration fits the temperature of the score, and per language the spread of the cross-entropy
against text length, from which the rejection bound follows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.llm import textvec
from boxlens.session import pin, release

ORDER = 5
BITS = 12
MAX_ENTRIES = 3_000_000      # (language, 5-gram) counts of one block of the model (more if two characters alone have more)
DISCOUNT = 0.75
FLUSH = 2_000_000            # n-grams a counting task holds before it hands them on
SLICE_BYTES = 1 << 18        # of text worked on at once: its arrays take over a hundred times as much
MIN_SPREAD = 6.0             # standard deviations a text may always lie above its language
MIN_GAIN = 0.25              # and the share of the model's usual gain over single characters that keeps a text
_MASK = [np.int64((1 << (BITS * o)) - 1) for o in range(ORDER + 1)]
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)


@functools.cache
def _classes() -> np.ndarray:
    """Code point -> character id: 0 for what is no letter; letters below U+1000 keep their own
    number in lower case, later ones share the 12 bits by a fixed hash."""
    t = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            t[cp] = low if low < 0x1000 else 0x40 + (low * 40503) % 0xFC0
    return t


def keys_of(data: np.ndarray, off: np.ndarray):
    """5-gram keys of consecutive texts: (keys of every scored character, offsets per text,
    letters per text)."""
    raw = data[off[0]:off[-1]].tobytes()
    try:
        text = raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:             # invalid bytes: text by text, with replacement characters
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        text = "".join(parts)
        coff = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    else:
        lead = np.concatenate([[0], np.cumsum((data[off[0]:off[-1]] & 0xC0) != 0x80)])
        coff = lead[off - off[0]]
    cls = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    before = np.empty(len(cls), bool)
    before[:1] = False
    before[1:] = cls[:-1] != 0
    before[coff[:-1][coff[:-1] < coff[1:]]] = False
    keep = (cls != 0) | before                       # of other characters, the first after a letter
    csum = np.concatenate([[0], np.cumsum(keep)])
    lsum = np.concatenate([[0], np.cumsum(cls != 0)])
    koff = csum[coff]
    # four spaces before every text
    n = len(koff) - 1
    pad = ORDER - 1
    kept = cls[keep].astype(np.int64)
    place = np.arange(len(kept)) + pad * (np.repeat(np.arange(n), np.diff(koff)) + 1)
    seq = np.zeros(len(kept) + pad * (n + 1), np.int64)
    seq[place] = kept
    key = np.zeros(len(kept), np.int64)
    for t in range(ORDER):
        key = (key << BITS) | seq[place - pad + t]
    return key, koff, np.diff(lsum[coff])


# ------------------------------------------------------------------ counting

def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


def _count(batches):
    held: dict[str, list] = {}

    def out(lang):
        k, c = _merge(held.pop(lang))
        for s in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[s:s + 200_000])), pa.array(k[s:s + 200_000]),
                                              pa.array(c[s:s + 200_000])], ["lang", "key", "n"])
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        lang = np.array(b.column("lang").to_pylist(), object)
        for i, j in textvec.slices(off, SLICE_BYTES):
            key, koff, _ = keys_of(data, off[i:j + 1])
            of = np.repeat(lang[i:j], np.diff(koff)) if j > i else lang[:0]
            for name in set(lang[i:j]):
                k, c = np.unique(key[of == name], return_counts=True)
                if not len(k):
                    continue
                parts = held.setdefault(name, [])
                parts.append((k, c.astype(np.int64)))
                if sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]) + FLUSH // 8:
                    parts[:] = [_merge(parts)]
                if sum(len(p[0]) for p in parts) > FLUSH:
                    yield from out(name)
    for name in list(held):
        yield from out(name)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n): all 5-gram counts of labelled ``docs`` (lang, text)."""
    return pin(docs.select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
                   .groupBy("lang", "key").agg(F.sum("n").alias("n")))


# ------------------------------------------------------------------ model

class HashArray:
    """Sorted array of mixed 60-bit keys with an index over the leading bits."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(textvec.mix64(keys.astype(np.uint64)))
        self.hash = textvec.mix64(keys[self.order].astype(np.uint64))
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(self.hash, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        h = textvec.mix64(keys.astype(np.uint64))
        n = len(self.hash)
        if n == 0:
            return np.full(len(h), -1)
        at = self.start[h >> self.shift]
        got = self.hash[np.minimum(at, n - 1)]
        late = np.flatnonzero((got < h) & (at < n))
        while len(late):
            at[late] += 1
            nxt = self.hash[np.minimum(at[late], n - 1)]
            got[late] = nxt
            late = late[(nxt < h[late]) & (at[late] < n)]
        return np.where((got == h) & (at < n), at, -1)


def build_model(langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray, low: dict | None = None) -> dict:
    """Interpolated Kneser-Ney: 5-gram counts, below that continuation counts (distinct left
    neighbours), absolute discounting, lower order weighted by the mass discounted.

    The counts of a block need ``low``, the continuation counts of orders 1 and 2 of the whole
    table; those above and all their contexts hold the block's two characters."""
    nl = len(langs)
    # order o holds its own n-grams, and the suffixes and contexts of order o + 1
    grams = {ORDER: np.unique(key)}
    cells = {ORDER: (lang, key, n.astype(np.float64))}
    for o in range(ORDER - 1, 0, -1):
        l, k, _ = cells[o + 1]
        suf = k & _MASK[o]
        code = np.unique(np.stack([l, suf]), axis=1, return_counts=True) if len(suf) else (np.zeros((2, 0), np.int64), np.zeros(0))
        cells[o] = (code[0][0], code[0][1], code[1].astype(np.float64))
        if low and o in low:
            cells[o] = low[o]
        grams[o] = np.unique(np.concatenate([grams[o + 1] & _MASK[o], grams[o + 1] >> BITS, cells[o][1]]))
    tables = {}
    lower = None
    for o in range(1, ORDER + 1):
        g = grams[o]
        count = np.zeros((len(g), nl))
        l, k, c = cells[o]
        count[np.searchsorted(g, k), l] = c
        if o == 1:
            total, kinds = count.sum(axis=0), (count > 0).sum(axis=0)
            lam = DISCOUNT * kinds / np.maximum(total, 1)
            p = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + np.maximum(lam, 1e-9) / (1 << BITS)
            base = np.log(np.maximum(lam, 1e-9) / (1 << BITS))
            first = p
        else:
            ctx = np.searchsorted(grams[o - 1], g >> BITS)
            m = len(grams[o - 1])
            total = np.stack([np.bincount(ctx, count[:, i], m) for i in range(nl)], axis=1)
            kinds = np.stack([np.bincount(ctx, count[:, i] > 0, m) for i in range(nl)], axis=1)
            lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = (np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[ctx]
                 + lam[ctx] * lower[np.searchsorted(grams[o - 1], g & _MASK[o - 1])])
            tables[o - 1]["back"] = np.log(lam)[tables[o - 1]["find"].order].astype(np.float32)
        ha = HashArray(g)
        tables[o] = {"find": ha, "logp": np.log(p)[ha.order].astype(np.float32)}
        lower = p
    for t in tables.values():
        t["find"].order = None
    # nats a character of a text that owes nothing to a language but its single characters
    single = np.tile(base.astype(np.float32), (1 << BITS, 1))
    single[grams[1]] = np.log(first)
    return {"langs": langs, "tables": tables, "base": base, "single": single}


def log_probs(model: dict, key: np.ndarray) -> np.ndarray:
    """(characters, languages) log-probabilities of the last character given the four before."""
    top = model["tables"][ORDER]
    at = top["find"].find(key)
    res = top["logp"][np.maximum(at, 0)] if len(top["logp"]) else np.zeros((len(key), len(model["langs"])), np.float32)
    rest = np.flatnonzero(at < 0)
    acc = np.zeros((len(rest), len(model["langs"])), np.float32)
    for o in range(ORDER - 1, 0, -1):
        if not len(rest):
            break
        t = model["tables"][o]
        ctx = t["find"].find((key[rest] & _MASK[o + 1]) >> BITS)
        seen = ctx >= 0
        acc[seen] += t["back"][ctx[seen]]
        at = t["find"].find(key[rest] & _MASK[o])
        hit = at >= 0
        res[rest[hit]] = acc[hit] + t["logp"][at[hit]]
        rest, acc = rest[~hit], acc[~hit]
    res[rest] = acc + model["base"].astype(np.float32)
    return res


def _arrays(langs: list[str], counts: DataFrame):
    """(lang, key, n) arrays of a table of counts."""
    t = counts.select("lang", "key", "n").toArrow()
    lang = np.searchsorted(np.array(langs), np.array(t["lang"].to_pylist(), dtype=np.array(langs).dtype))
    return lang.astype(np.int64), t["key"].to_numpy(), t["n"].to_numpy()


def _pair(key):
    """Third and fourth character of 5-grams."""
    return (key >> BITS) & _MASK[2]


def _blocks(counts: DataFrame, max_entries: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of character pairs, each of ``max_entries`` counts at most or one pair."""
    hist = counts.groupBy(F.shiftright("key", BITS).bitwiseAND(F.lit(int(_MASK[2]))).alias("pair")).agg(F.count("*").alias("c")).toArrow()
    pair, c = hist["pair"].to_numpy(), hist["c"].to_numpy()
    order = np.argsort(pair)
    firsts, held = [0], 0
    for p, n in zip(pair[order].tolist(), c[order].tolist()):
        if held and held + n > max_entries:
            firsts.append(p)
            held = 0
        held += n
    return list(zip(firsts, [*(f - 1 for f in firsts[1:]), int(_MASK[2])]))


def _lower(langs: list[str], counts: DataFrame) -> dict:
    """Continuation counts of orders 2 and 1 from all counts: at most as many as there are pairs
    of characters."""
    cut = lambda o: F.col("key").bitwiseAND(F.lit(int(_MASK[o]))).alias("key")
    two = pin(counts.select("lang", cut(3)).distinct().groupBy("lang", cut(2)).agg(F.count("*").alias("n")))
    cells = {o: _arrays(langs, t) for o, t in ((2, two), (1, two.groupBy("lang", cut(1)).agg(F.count("*").alias("n"))))}
    release(two)
    low = {}
    for o, (lang, key, n) in cells.items():
        order = np.lexsort((key, lang))
        low[o] = (lang[order], key[order], n[order].astype(np.float64))
    return low


def fit_blocks(docs: DataFrame, max_entries: int = MAX_ENTRIES):
    """(langs, blocks) from labelled rows (lang, text): an iterator of (first pair, last pair, model);
    no langs without any row."""
    counts = ngram_counts(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())

    def models():
        ranges = _blocks(counts, max_entries)
        low = _lower(langs, counts) if len(ranges) > 1 else None
        for a, b in ranges:
            part = counts
            if low:
                part = counts.filter(F.shiftright("key", BITS).bitwiseAND(F.lit(int(_MASK[2]))).between(a, b))
            yield a, b, build_model(langs, *_arrays(langs, part), low)
    return langs, models()


def fit(docs: DataFrame) -> dict | None:
    """The whole model from labelled rows (lang, text) in one piece; None without any."""
    langs, blocks = fit_blocks(docs, 1 << 62)
    return next(blocks)[2] if langs else None


def _score(model_bc, first: int, last: int):
    """Cross-entropies per language, of the model and of its single characters (bare), as far as
    the characters of one block make them up."""
    def score(batches):
        model = model_bc.value
        nl = len(model["langs"])
        for b in batches:
            data, off = textvec.buffers(b.column("text"))
            for i, j in textvec.slices(off, SLICE_BYTES):
                key, koff, letters = keys_of(data, off[i:j + 1])
                ce, bare = np.zeros((j - i, nl)), np.zeros((j - i, nl))
                full = np.flatnonzero(np.diff(koff) > 0)
                if len(full):
                    own = slice(None) if first == 0 and last == _MASK[2] else np.flatnonzero((_pair(key) >= first) & (_pair(key) <= last))
                    for sums, logp in ((ce, log_probs(model, key[own])), (bare, model["single"][key[own] & _MASK[1]])):
                        every = logp
                        if not isinstance(own, slice):
                            every = np.zeros((len(key), nl), np.float32)
                            every[own] = logp
                        sums[full] = -np.add.reduceat(every, koff[full], axis=0, dtype=np.float64)
                        sums[full] /= np.diff(koff)[full, None]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in ("doc_id", "lang", "th")), pa.array(np.diff(koff), pa.int64()),
                     pa.array(letters, pa.int64()),
                     *(pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * nl, pa.int32()), pa.array(x.ravel())) for x in (ce, bare))],
                    ["doc_id", "lang", "th", "chars", "letters", "ce", "bare"])
    return score


def fold(doc_id: Column) -> Column:
    """0: counts, 2: calibration, 1: held out (also rows without a doc_id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(1)).cast("int")


def identify(docs: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score,
    cross_entropy (of the chosen language, nats a character), rejected, th (hash of the text).

    lang_pred is a learned lang value for every text with a letter, else 'und' (null, empty or
    letterless text, or nothing to learn from) with score 0, null cross_entropy and rejected.
    score is the calibrated posterior of lang_pred.  rejected marks texts whose cross-entropy
    lies above the bound of its language at their length, and on which the model gains less than a
    quarter of what it usually gains over its single characters (order 1 on the same text).  lang, source and doc_id are never
    inputs of a prediction; equal cross-entropies go to the smaller lang value; rows without
    lang are predicted like others.  Other columns are ignored."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                      F.col("lang").cast("string").alias("lang"))
    langs, blocks = fit_blocks(src.filter(fold(F.col("doc_id")) == 0), max_entries)
    if not langs:
        return src.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.lit("und").alias("lang_pred"),
                          F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"),
                          F.lit(True).alias("rejected"), F.xxhash64("text").alias("th"))
    hashed = src.withColumn("th", F.xxhash64("text"))
    parts = []
    for first, last, model in blocks:
        sent = spark.sparkContext.broadcast(model)
        parts.append(pin(hashed.mapInArrow(_score(sent, first, last),
                                           f"doc_id {kind}, lang string, th long, chars long, letters long, ce array<double>, bare array<double>")))
        sent.unpersist()
        del model
    scored = parts[0]
    if len(parts) > 1:
        # rows alike in doc_id, lang and text have the same parts: summed once, then as many rows again
        whole = functools.reduce(DataFrame.unionByName, parts)
        sums = [(F.sum(F.col(c)[i]) / F.count("*") * len(parts)).alias(f"{c}{i}") for c in ("ce", "bare") for i in range(len(langs))]
        scored = pin(whole.groupBy("doc_id", "lang", "th", "chars", "letters").agg(F.count("*").alias("_n"), *sums)
                          .withColumn("_i", F.explode(F.sequence(F.lit(1), (F.col("_n") / len(parts)).cast("int"))))
                          .select("doc_id", "lang", "th", "chars", "letters", *[F.array(*[f"{c}{i}" for i in range(len(langs))]).alias(c) for c in ("ce", "bare")]))
        release(*parts)
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_min("ce")
    at = F.array_position("ce", best).cast("int")
    known = F.col("letters") > 0
    rows = scored.select("doc_id", "lang", "th", "chars", "ce", known.alias("known"), best.alias("best"), F.element_at(names, at).alias("pred"),
                         (F.element_at("bare", at) - best).alias("gain"))

    # calibration on fold 2: temperature of the score, and the spread of each language
    cal = rows.filter((fold(F.col("doc_id")) == 2) & F.col("known") & F.col("lang").isin(langs))
    own = F.element_at("ce", F.array_position(names, F.col("lang")).cast("int"))

    def log_norm(t):
        return F.log(F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp((F.col("best") - x) * t)))
    losses = cal.agg(*[F.avg(log_norm(t) + (own - F.col("best")) * t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    temperature = min(((losses[i], t) for i, t in enumerate(TEMPERATURES) if losses[i] is not None), default=(0, 8.0))[1]
    right = cal.filter(F.col("pred") == F.col("lang"))
    # the median: a few odd texts, however long, do not move it
    middle = right.groupBy("pred").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in ("best", "gain")]).collect()
    mean, usual = ({r["pred"]: r[c] for r in middle} for c in ("best", "gain"))

    def per_lang(values: dict, default: float) -> Column:
        return F.element_at(F.array(*[F.lit(float(values.get(x, default))) for x in langs]), F.array_position(names, F.col("pred")).cast("int"))
    dev = F.col("best") - per_lang(mean, math.inf)
    short = {r["pred"]: (r["a"], r["b"]) for r in right.groupBy("pred").agg(
        F.avg(dev * dev * F.least("chars", F.lit(256))).alias("a"), F.avg(dev * dev).alias("b")).collect()}
    spread = F.sqrt(per_lang({k: v[0] for k, v in short.items()}, 1.0) / F.col("chars") + per_lang({k: v[1] for k, v in short.items()}, 1.0)) + 1e-9
    z = dev / spread
    # the bound lies well beyond what calibration rows of the language show
    wide = {r["pred"]: max(MIN_SPREAD, 1.5 * r["q"]) for r in right.groupBy("pred").agg(F.percentile_approx(z, 0.999, 10_000).alias("q")).collect()}
    # a text with tokens or repetitions between its words is still of the language: it goes only if
    # the model gains next to nothing on it
    lost = F.col("gain") < MIN_GAIN * F.greatest(per_lang(usual, 0.0), F.lit(0.0))
    rejected = ~F.col("known") | ((z > per_lang(wide, MIN_SPREAD)) & lost)
    return rows.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"),
        F.when(F.col("known"), F.col("pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("known"), F.exp(-log_norm(temperature))).otherwise(0.0).alias("score"),
        F.when(F.col("known"), F.col("best")).alias("cross_entropy"), rejected.alias("rejected"), "th")
