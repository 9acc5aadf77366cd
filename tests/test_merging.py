"""Three series merged at two seams, against a plain search over all seams."""

import math
import random

import pytest

from loomspark.operators import merging


def brute_force(left, anchor, right, least, blend):
    """Entry, exit and the merged values; series are dicts from place to value."""

    def seam(current, following, low):
        both = sorted(set(current) & set(following))
        found = [(abs(current[s - 1] - following[s]), s) for s in both[1:] if s >= low]
        return min(found) if found else None

    def merged(current, following, s):
        both = sorted(set(current) & set(following))
        start, stop = max(both[0], s - blend), min(both[-1] + 1, s + blend)
        out = {i: v for i, v in current.items() if i < start} | {i: v for i, v in following.items() if i >= stop}
        for n, i in enumerate(range(start, stop)):
            alpha = 0.5 - 0.5 * math.cos(math.pi * (n + 1) / (stop - start + 1))
            out[i] = current[i] * (1 - alpha) + following[i] * alpha
        return out

    entry = seam(left, anchor, -math.inf)
    if entry is None:
        return None, None, None
    first = merged(left, anchor, entry[1])
    low = max(min(right), entry[1] + least + 2 * blend - 1)
    rest = {i: v for i, v in right.items() if i >= low}
    end = seam(first, rest, low + 1) if set(first) & set(rest) else None
    return entry, end, merged(first, rest, end[1]) if end else None


def frames(spark, cases, i):
    rows = [(key, at, v) for key, sides in cases.items() for at, v in sides[i].items()]
    return spark.createDataFrame(rows, "k string, at int, v double")


@pytest.mark.parametrize(("least", "blend"), [(3, 1), (1, 0), (5, 2)])
def test_against_all_seams(spark, least, blend):
    rnd = random.Random(least)
    cases = {}
    for n in range(12):
        a, b, c = rnd.randint(8, 14), rnd.randint(4, 7), rnd.randint(10, 13)
        value = lambda: float(rnd.randint(0, 6))
        cases[f"c{n}"] = ({i: value() for i in range(a)}, {i: value() for i in range(b, b + 14)}, {i: value() for i in range(c, c + 12)})
    cases["plain"] = ({i: float(i) for i in range(12)}, {i: float(i) for i in range(6, 16)}, {i: float(i) for i in range(10, 21)})
    cases["short"] = ({i: 0.0 for i in range(8)}, {i: 0.0 for i in range(5, 12)}, {i: 0.0 for i in range(11, 20)})
    seams, merged = merging.merge_anchored(*(frames(spark, cases, i) for i in range(3)), ["k"], "at", "v", least, blend)
    found = {r.k: r for r in seams.collect()}
    series = {}
    for r in merged.collect():
        series.setdefault(r.k, {})[r.at] = r
    for k, (left, anchor, right) in cases.items():
        entry, end, want = brute_force(left, anchor, right, least, blend)
        assert (found[k].entry_cost, found[k].entry) == entry
        if end is None:
            assert found[k].exit is None and found[k].retained is None and k not in series
            continue
        assert (found[k].exit_cost, found[k].exit) == end and found[k].retained >= least
        assert {at: r.v for at, r in series[k].items()} == pytest.approx(want)
        for at in range(found[k].retained_start, found[k].retained_end):
            assert series[k][at].v == anchor[at] and series[k][at].part == "anchor"


def test_the_core_of_the_anchor_stays(spark):
    cases = {"a": ({i: float(i) for i in range(12)}, {i: float(i) for i in range(6, 16)}, {i: float(i) for i in range(10, 21)})}
    seams, merged = merging.merge_anchored(*(frames(spark, cases, i) for i in range(3)), ["k"], "at", "v", 3, 1)
    row = seams.first()
    assert (row.entry, row.exit, row.retained_start, row.retained_end, row.retained) == (7, 12, 8, 11, 3) and merged.count() == 21
    with pytest.raises(ValueError):
        merging.anchored_seams(seams, seams, ["k"], "entry", "entry_cost", 0)
