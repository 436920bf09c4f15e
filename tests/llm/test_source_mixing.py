import random
from collections import defaultdict

from quern.llm import source_mixing as M


def waterfill(sizes):
    """Targets by repeated resharing, as the rule states it."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **target}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_budgets(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["a", "a", "a", "a", "b", "é", "z", "zz", None])) for i in range(600)] + [(600, None, "a"), (601, "", "only empty"), (602, "one", "tiny")]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    again = M.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    pick = lambda x: {y["doc_id"]: (y["size"], y["source_size"], y["target"], y["taken"]) for y in x}
    assert pick(out) == pick(again) and len(out) == len(rows)
    source = {d: s for d, _, s in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for y in out:
        s = source[y["doc_id"]]
        sizes[s] += y["size"]
        taken[s] += y["taken"]
        target[s] = y["target"]
        assert 0 <= y["taken"] <= 3 * y["size"]
    want = waterfill(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s] + 1e-9)


def test_documents_of_the_mix(spark):
    rows = [(i, "w " * 10, "a", i) for i in range(30)] + [(100 + i, "w " * 10, "b", i) for i in range(300)] + [(500, None, "b", 1), (None, "x y", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int")
    out = M.mixed_documents(df).collect()
    n_a = sum(r["source"] == "a" for r in out)
    assert n_a == 90 and out[0].asDict().keys() == {"doc_id", "text", "source", "_copies"}
    assert not any(r["text"] is None for r in out)
    assert M.mixed_documents(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0
