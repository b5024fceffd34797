"""Statistics and windows: FIXTURES edge rows and brute-force comparisons."""
import math
import random
import statistics

from tonekit.operators import agreement as agr
from tonekit.operators import clean, stats, windows


def test_progress(spark):
    df = spark.createDataFrame([(1, r) for r in range(4)], "id long, rank_sentence int")
    got = [r.percentage for r in windows.speech_progress(df).orderBy("rank_sentence").collect()]
    assert got == [0.25, 0.5, 0.75, 1.0]


def test_rolling_mean5(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "id long, rank_sentence int, y double")
    got = [r.y_ma5 for r in windows.rolling_mean(df, "y").orderBy("rank_sentence").collect()]
    assert got == [None, None, None, None, 3.0, None]


def test_histogram_four_bins(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 0.25, 0.9, 1.0)], "g int, x double")
    got = [r.n for r in stats.histogram_pct(df, "x", "g", bins=4).orderBy("bin").collect()]
    assert got == [1, 1, 0, 2]


def test_histogram_constant_group(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0)], "g int, x double")
    rows = stats.histogram_pct(df, "x", "g", bins=20).where("n > 0").collect()
    assert len(rows) == 1 and rows[0].bin == 10 and rows[0].pct == 100.0


def test_crosstab_classes_pivot(spark):
    df = spark.createDataFrame([("negative", "negative"), ("negative", "positive"), ("positive", "positive")], "r string, c string")
    got = {r.r: (r.negative, r.neutral, r.positive) for r in agr.crosstab_classes(df, "r", "c").collect()}
    assert got == {"negative": (0.5, 0.0, 0.5), "positive": (0.0, 0.0, 1.0)}


def test_corr_nonzero_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 7.0), (None, 1.0), (9.0, None)], "compound double, polarity double")
    r = {(x.var1, x.var2): x.r for x in agr.corr_matrix(df).collect()}
    assert abs(r[("compound", "polarity")] - 0.944911) < 1e-6
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "compound double, polarity double")
    r2 = {(x.var1, x.var2): x.r for x in agr.corr_matrix(const).collect()}
    assert r2[("compound", "polarity")] is None


def test_median_exact(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 4.0)] + [(2, 5.0)], "g int, x double")
    got = {r.g: r.median for r in stats.median_by(df, "g", "x").collect()}
    assert got == {1: 3.0, 2: 5.0}


def test_median_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), round(rnd.uniform(-1, 1), 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.median for r in stats.median_by(df, "g", "x").collect()}
    for g in range(4):
        assert abs(got[g] - statistics.median([x for k, x in rows if k == g])) < 1e-12


def test_mann_whitney_ties(spark):
    a, b = [1, 2, 2, 5], [2, 3, 4, 5, 6]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, x double")
    r = stats.mann_whitney(df, "x", "g", "a", "b").first()
    assert (r.r1, r.u1, r.u2, r.ties) == (14.5, 4.5, 15.5, 30)
    assert r.u1 + r.u2 == len(a) * len(b)
    # normal approximation with tie correction and continuity correction
    n1, n2, n = 4, 5, 9
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - 30 / (n * (n - 1))))
    z = (abs(4.5 - n1 * n2 / 2) - 0.5) / sigma
    assert abs(r.z - z) < 1e-12
    assert abs(r.p_two_sided - math.erfc(z / math.sqrt(2))) < 1e-6


def test_summary_single_row_std_null(spark):
    df = spark.createDataFrame([(1, 0, 2.0, "x")], "id long, rank_sentence int, v double, party string")
    r = stats.summary_by(df, "id", "v", "party", "rank_sentence").first()
    assert r.std is None and r.mean == 2.0 and r.party == "x"


def test_kde_integrates_to_one(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([("a", round(rnd.gauss(0, 0.3), 4)) for _ in range(3000)], "g string, x double")
    rows = stats.kde(df, "x", "g").orderBy("i").collect()
    step = rows[1].x - rows[0].x
    assert abs(sum(r.density for r in rows) * step - 1.0) < 0.01


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("b", "x", 3), ("a", None, 4), ("a", None, 5)],
                               "author string, text string, id long")
    assert sorted(r.id for r in clean.dedupe(df, ["author", "text"], "id").collect()) == [1, 3, 4]


def test_nonzero_pairs_keep_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (None, 1.0)], "a double, b double")
    assert clean.drop_if_any_zero(df, ["a", "b"]).count() == 2


def test_top_n_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 9)}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "author string, post_id long")
    got = {(r.author, r.post_id) for r in windows.top_n_per_group(df, "author", "post_id", 7).collect()}
    want = set()
    for g in {a for a, _ in rows}:
        ids = sorted((i for a, i in rows if a == g), reverse=True)[:7]
        want |= {(g, i) for i in ids}
    assert got == want


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(5)
    keys = rnd.sample(range(100000), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(13)
    got = {r.k: r.row_number for r in windows.global_row_number(df, ["k"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_drop_by_position(spark):
    df = spark.createDataFrame([(k,) for k in range(25)], "k int")
    got = [r.k for r in clean.drop_by_position(df, ["k"], [16], drop_last=True).orderBy("k").collect()]
    assert got == [k for k in range(24) if k != 16]


def test_agreement_pct_sums(spark):
    df = spark.createDataFrame([(0.5, 0.2, 3), (-0.5, 0.0, 1), (0.0, 0.0, 2), (None, 0.1, 4)],
                               "compound double, polarity double, ordinal int")
    rows = agr.agreement_pct(df).collect()
    for pair in {r.pair for r in rows}:
        assert abs(sum(r.pct for r in rows if r.pair == pair) - 100.0) < 1e-9


def test_rolling_mean_gaps_nulls_and_pieces(spark, monkeypatch):
    import random
    monkeypatch.setattr(windows, "PIECE", 16)
    r = random.Random(3)
    rows = [(i, k, None if r.random() < 0.05 else float(r.randint(-9, 9))) for i in (1, 2, None) for k in range(150) if r.random() > 0.05]
    df = spark.createDataFrame(rows, "id long, rank_sentence int, y double")
    by = {(i, k): v for i, k, v in rows}
    want = {}
    for i, k, _ in rows:
        last = [by.get((i, j)) for j in range(k - 4, k + 1)]
        want[i, k] = None if None in last else sum(last) / 5
    got = {(x.id, x.rank_sentence): x.y_ma5 for x in windows.rolling_mean(df, "y").collect()}
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_kde_equals_the_direct_sum(spark):
    import math
    import random
    r = random.Random(9)
    values = [r.gauss(0, 1) for _ in range(300)] + [r.gauss(40, 0.01) for _ in range(50)] + [7.5] * 40
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    n, mean = len(values), sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n ** -0.2
    for p in stats.kde(df, "x", "g").collect():
        direct = sum(math.exp(-0.5 * ((p.x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert abs(p.density - direct) < 1e-12


def test_median_of_raw_doubles(spark):
    import random
    import statistics
    r = random.Random(5)
    nan, inf = float("nan"), float("inf")
    groups = {"a": [r.gauss(0, 1) * 10 ** r.randint(-300, 300) for _ in range(501)], "b": [0.0, -0.0, -1.5, 1.5], "c": [-inf, inf, 3.0],
              "d": [5e-324], "e": [2.5] * 700 + [r.random() for _ in range(300)], "f": [-1e308, -1e-308]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", nan), ("a", None), (None, 1.0), ("z", nan)]
    got = {x.g: (x.median, x.n) for x in stats.median_of_raw(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {g: (statistics.median(vs), len(vs)) for g, vs in groups.items()}


def test_exact_p_equals_enumeration(spark):
    import itertools
    import random
    r = random.Random(2)
    for m, n in ((1, 1), (2, 3), (3, 8), (8, 8), (5, 4), (8, 20), (9, 9)):
        values = r.sample(range(1000), m + n)
        df = spark.createDataFrame([(1, float(v)) for v in values[:m]] + [(0, float(v)) for v in values[m:]], "g int, x double")
        row = stats.mann_whitney(df, "x", "g", 1, 0).first()
        u = sum(a > b for a in values[:m] for b in values[m:])
        assert row.u1 == u
        if m > 8:
            assert row.method == "normal"
            continue
        assert row.method == "exact"
        if m + n > 16:
            assert abs(row.p_greater + row.p_less - 1) < 0.2
            continue
        sums = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        up = sum(s >= u for s in sums) / len(sums)
        down = sum(s >= m * n - u for s in sums) / len(sums)
        two = min(1.0, 2 * sum(s >= max(u, m * n - u) for s in sums) / len(sums))
        assert abs(row.p_greater - up) < 1e-12 and abs(row.p_less - down) < 1e-12 and abs(row.p_two_sided - two) < 1e-12
    tied = spark.createDataFrame([(1, 1.0), (0, 1.0), (0, 2.0)], "g int, x double")
    assert stats.mann_whitney(tied, "x", "g", 1, 0).first().method == "normal"
