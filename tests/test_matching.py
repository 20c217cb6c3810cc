"""Window/fold matching against plain Python loops on random images (the reference's loop
semantics, with the deterministic tie rules of the survey)."""

import random

from pyspark.sql import functions as F

from boxlens.operators import matching as M
from boxlens.operators import errors as E
from boxlens.operators import evaluate as EV


def _iou(a, b):
    ax2, ay2, bx2, by2 = a[1] + a[3], a[2] + a[4], b[1] + b[3], b[2] + b[4]
    iw = max(0.0, min(ax2, bx2) - max(a[1], b[1]))
    ih = max(0.0, min(ay2, by2) - max(a[2], b[2]))
    inter = iw * ih
    union = (ax2 - a[1]) * (ay2 - a[2]) + (bx2 - b[1]) * (by2 - b[2]) - inter
    return inter / union if union > 0 else 0.0


def _random_boxes(seed, n_img=40, cats="abc"):
    rnd = random.Random(seed)
    gts, prs = [], []
    for img in range(n_img):
        for g in range(rnd.randint(0, 6)):
            x, y = rnd.randint(0, 300), rnd.randint(0, 300)
            gts.append((f"g{img}_{g}", str(img), rnd.choice(cats), float(x), float(y), float(rnd.randint(5, 60)), float(rnd.randint(5, 60))))
        for p in range(rnd.randint(0, 8)):
            if gts and rnd.random() < 0.7:
                base = rnd.choice([g for g in gts if g[1] == str(img)] or [gts[-1]])
                x, y, w, h = base[3] + rnd.randint(-8, 8), base[4] + rnd.randint(-8, 8), base[5], base[6]
            else:
                x, y, w, h = rnd.randint(0, 300), rnd.randint(0, 300), rnd.randint(5, 60), rnd.randint(5, 60)
            prs.append((f"p{img}_{p}", str(img), rnd.choice(cats), float(x), float(y), float(w), float(h),
                        round(rnd.random(), 2)))
    return gts, prs


def _frames(spark, gts, prs):
    cols = "id string, sample_id string, category_name string, bbox_x double, bbox_y double, bbox_w double, bbox_h double"
    g = spark.createDataFrame(gts, cols).withColumn("dataset_id", F.lit("d")).withColumn("confidence", F.lit(None).cast("double"))
    p = spark.createDataFrame(prs, cols + ", confidence double").withColumn("dataset_id", F.lit("d"))
    return p, g


def _loop_error_analysis(gts, prs, t):
    out = {}
    for img in {x[1] for x in gts} | {x[1] for x in prs}:
        G = sorted([g for g in gts if g[1] == img], key=lambda g: g[0])
        P = sorted([p for p in prs if p[1] == img], key=lambda p: (-p[7], p[0]))
        taken = set()
        for p in P:
            best, bi = -1.0, None
            for g in G:
                v = _iou((None,) + p[3:7], (None,) + g[3:7])
                if v > best:
                    best, bi = v, g
            if bi is not None and best >= t and bi[0] not in taken:
                taken.add(bi[0])
                out[p[0]] = "tp" if bi[2] == p[2] else "label_error"
            else:
                out[p[0]] = "hard_fp"
        for g in G:
            if g[0] not in taken:
                out[g[0]] = "false_negative"
    return out


def _loop_greedy(gts, prs, t):
    out = {}
    for img in {x[1] for x in prs}:
        G = sorted([g for g in gts if g[1] == img], key=lambda g: g[0])
        P = sorted([p for p in prs if p[1] == img], key=lambda p: (-p[7], p[0]))
        taken = set()
        for p in P:
            best, bi = 0.0, None
            for g in G:
                if g[0] in taken or g[2] != p[2]:
                    continue
                v = _iou((None,) + p[3:7], (None,) + g[3:7])
                if v > best:
                    best, bi = v, g
            if bi is not None and best >= t:
                taken.add(bi[0])
                out[p[0]] = bi[0]
            else:
                out[p[0]] = None
    return out


def test_error_labels_equal_loop(spark):
    for seed in (1, 2):
        gts, prs = _random_boxes(seed)
        p, g = _frames(spark, gts, prs)
        ann = p.withColumn("source", F.lit("r")).unionByName(g.withColumn("source", F.lit("ground_truth")))
        got = {r.annotation_id: r.error_type for r in E.error_labels(ann, "d", "r", 0.5, 0.0, cell=32.0).collect()}
        assert got == _loop_error_analysis(gts, prs, 0.5)


def _loop_one_to_one(gts, prs, t):
    pairs = []
    for p in prs:
        for g in gts:
            if p[1] == g[1]:
                v = _iou((None,) + p[3:7], (None,) + g[3:7])
                if v > t:
                    pairs.append((p[2] != g[2], -v, p[0], g[0]))
    taken, out = set(), set()
    for _, _, p, g in sorted(pairs):
        if p not in taken and g not in taken:
            taken |= {p, g}
            out.add((p, g))
    return out


def test_folds_of_images_and_of_components_equal_loops(spark, monkeypatch):
    """Whole images packed into tasks, all images split into components, and only the larger ones."""
    gts, prs = _random_boxes(3)
    p, g = _frames(spark, gts, prs)
    want, one = _loop_greedy(gts, prs, 0.3), _loop_one_to_one(gts, prs, 0.2)
    searched = []
    search = M.connected_components
    monkeypatch.setattr(M, "connected_components", lambda e: searched.append(e.count()) or search(e))
    for pack, split in ((50_000, "none"), (0, "all"), (3, "some")):
        monkeypatch.setattr(M, "FOLD_PACK_PAIRS", pack)
        searched.clear()
        got = {r.p_id: r.g_id for r in M.greedy_match(p, g, [0.3], cell=48.0).collect()}
        assert got == want
        assert {(r.p_id, r.g_id) for r in M.confusion_match(p, g, 0.2, cell=48.0).collect()} == one
        total = M.candidate_pairs(p, g).filter("iou > 0.2").count()
        assert {"none": searched == [], "all": searched[-1:] == [total], "some": 0 < sum(searched[-1:]) < total}[split]
    assert M.greedy_match(p.limit(0), g, [0.3]).collect() == [] == M.confusion_match(p, g.limit(0), 0.3).collect()


def test_several_thresholds_in_one_fold(spark):
    gts, prs = _random_boxes(5)
    p, g = _frames(spark, gts, prs)
    rows = M.greedy_match(p, g, [0.7, 0.1, 0.4]).collect()
    for t in (0.1, 0.4, 0.7):
        assert {r.p_id: r.g_id for r in rows if r.t == t} == _loop_greedy(gts, prs, t)


def test_meetings_stay_linear_with_one_large_box(spark):
    """Boxes only meet where one of them is at home: a box over the whole image meets each other box
    once a cell and brings no two small ones together."""
    rnd = random.Random(12)
    n = 2000
    box = lambda k, i: (f"{k}{i:05d}", "s1", "a", rnd.uniform(0, 8000), rnd.uniform(0, 8000), rnd.uniform(4, 8), rnd.uniform(4, 8))
    gts, prs = [box("g", i) for i in range(n)], [(*box("p", i), 0.5) for i in range(n)]

    def meetings(g_rows):
        p, g = _frames(spark, g_rows, prs)
        a, b = M.placed_sides(p, g)
        return a.join(b, ["dataset_id", "sample_id", "turn", "level", "cx", "cy"]).count(), M.candidate_pairs(p, g).count()
    base, pairs = meetings(gts)
    with_large, more = meetings([*gts, ("gall", "s1", "a", 0.0, 0.0, 8100.0, 8100.0)])
    assert more == pairs + n
    assert with_large <= base + 2 * n and base < 4 * n


def test_candidate_pairs_exact_once(spark):
    gts, prs = _random_boxes(4)
    p, g = _frames(spark, gts, prs)
    for cell in (16.0, 128.0):
        got = sorted((r.p_id, r.g_id) for r in M.candidate_pairs(p, g, cell=cell).collect())
        want = sorted((a[0], b[0]) for a in prs for b in gts if a[1] == b[1]
                      and min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3]) and min(a[4] + a[6], b[4] + b[6]) > max(a[4], b[4]))
        assert got == want


def test_running_counts_match_window(spark):
    from boxlens.operators.cumulative import running_counts
    rnd = random.Random(7)
    rows = [(f"k{rnd.randint(0, 2)}", f"i{i:04d}", round(rnd.random(), 1), rnd.randint(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id string, c double, f int")
    got = {(r.k, r.id): (r.rank, r.cum) for r in running_counts(df, ["k"], [F.col("c").desc(), F.col("id")], "f", 7).collect()}
    for k in {r[0] for r in rows}:
        sub = sorted([r for r in rows if r[0] == k], key=lambda r: (-r[2], r[1]))
        cum = 0
        for i, r in enumerate(sub, 1):
            cum += r[3]
            assert got[(k, r[1])] == (i, cum)


def test_interpolated_ap_hand_case(spark):
    # 2 GT; predictions tp (0.9), fp (0.8), tp (0.7): P/R points (1, .5), (.5, .5), (2/3, 1)
    pts = spark.createDataFrame([("c", 2, 0.5, 1.0), ("c", 2, 0.5, 0.5), ("c", 2, 1.0, 2 / 3)],
                                "class_name string, n_gt long, recall double, precision double")
    classes = spark.createDataFrame([("c",)], "class_name string")
    ap = EV.interpolated_ap(pts, classes).first().ap
    assert abs(ap - (51 * 1.0 + 50 * (2 / 3)) / 101) < 1e-12


def test_pairs_of_very_different_sizes_and_a_dense_spot(spark):
    rnd = random.Random(11)
    gts, prs = [], []
    for k, out in ((0, gts), (1, prs)):
        for i in range(150):
            side = 2.0 ** rnd.uniform(0, 12)
            out.append((f"{'gp'[k]}{i:03d}", "s1", "a", rnd.uniform(-50, 4000), rnd.uniform(-50, 3000), side * rnd.uniform(.3, 1), side * rnd.uniform(.3, 1), 0.5))
        for i in range(150):           # many small boxes at one spot
            out.append((f"{'gp'[k]}d{i:03d}", "s1", "a", 100 + rnd.uniform(0, 30), 100 + rnd.uniform(0, 30), rnd.uniform(1, 4), rnd.uniform(1, 4), 0.5))
    p, g = _frames(spark, [r[:7] for r in gts], prs)
    got = sorted((r.p_id, r.g_id) for r in M.candidate_pairs(p, g).collect())
    want = sorted((a[0], b[0]) for a in prs for b in gts
                  if min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3]) and min(a[4] + a[6], b[4] + b[6]) > max(a[4], b[4]))
    assert got == want


def test_running_counts_of_several_flags_over_batches(spark):
    from boxlens.operators.cumulative import running_counts
    rows = [(None if i % 5 == 4 else i % 3 % 2, i, i * 7 % 31, i % 2, i % 3 % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, c int, f int, g int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = running_counts(df, ["k"], [F.col("c").desc(), F.col("id")], ["f", "g"], 3)
        got = {(r.k, r.id): (r.rank, r.cum, r.total) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in (0, 1):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        for n, r in enumerate(mine, 1):
            want[k, r[1]] = (n, [sum(x[3] for x in mine[:n]), sum(x[4] for x in mine[:n])], len(mine))
    assert got == want


def test_boxes_stand_only_where_others_can_come(spark):
    from boxlens.operators.matching import placed_sides
    cols = "dataset_id string, sample_id string, id string, category_name string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double"
    p = spark.createDataFrame([("d", "1", f"p{i}", "A", 10.0 * i, 1.0, 20.0, 20.0, 0.5) for i in range(4)], cols)
    g = spark.createDataFrame([("d", "1", f"g{i}", "A", 10.0 * i, 2.0, 20.0, 20.0, None) for i in range(4)], cols)
    _, gs = placed_sides(p, g)
    assert {r.turn for r in gs.select("turn").distinct().collect()} == {0}          # all of one level: none is a place of its own
    assert M.candidate_pairs(p, g).count() == sum(abs(i - j) < 2 for i in range(4) for j in range(4))
