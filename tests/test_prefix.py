"""Places and running sums against a plain loop, with a group that holds most rows."""

import random
from collections import defaultdict

from slatewing.operators.prefix import running


def test_running_equals_a_loop(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([None, *range(9)]), "clash") for i in range(700)]
    r.shuffle(rows)
    want, place, total = {}, defaultdict(int), defaultdict(int)
    for k, i, v, _ in sorted(rows, key=lambda x: x[1]):
        place[k] += 1
        want[i] = (k, place[k], total[k])
        total[k] += v or 0
    df = spark.createDataFrame(rows, "k string, i int, v int, value string")
    got = running(df, ["k"], ["i"], "v")
    assert {x.i: (x.k, x.place, x.before) for x in got.collect()} == want and got.columns == ["k", "i", "v", "value", "place", "before"]
    assert running(df.limit(0), ["k"], ["i"]).count() == 0
