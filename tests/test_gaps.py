"""Gap repair and splice against trying every way in plain Python; caps."""

import itertools
import math
import random

import pytest

from latticeworks.operators import gaps, restraints


def nearest(known, r, step):
    low, high = [k for k in known if k < r], [k for k in known if k > r]
    if low and high:
        a, b = max(low), min(high)
        return [known[a][i] + (known[b][i] - known[a][i]) * (r - a) / (b - a) for i in range(3)]
    end, toward = (max(low), -1) if low else (min(high), 1)
    inner = next((end + toward * k for k in (1, 2) if end + toward * k in known), None)
    d = [known[end][i] - known[inner][i] for i in range(3)] if inner is not None else [-float(toward), 0.0, 0.0]
    length = math.dist(d, (0, 0, 0))
    return [known[end][i] + d[i] / length * step * abs(r - end) for i in range(3)]


def plain(sites, wanted, fixed, groups):
    best = None
    for way in itertools.combinations(range(max(len(sites), len(wanted))), min(len(sites), len(wanted))):
        pairs = list(zip(wanted, [sites[k] for k in way])) if len(sites) >= len(wanted) else list(zip([wanted[k] for k in way], sites))
        known = {**fixed, **{r: s[1] for r, s in pairs}}
        for r in sorted(set(wanted) - set(known)):  # one after the other, so later ones see earlier ones at a chain's end
            known_now = {k: v for k, v in known.items()}
            known[r] = nearest({k: v for k, v in known_now.items() if k in fixed or k in dict(pairs) or k < r}, r, 6.0) if any(k > r for k in known_now) else nearest(known_now, r, 6.0)
        line = [known[r] for r in range(wanted[0] - 1, wanted[-1] + 2) if r in known and (r in wanted or r in fixed)]
        score = -sum((math.dist(a, b) - 6.0) ** 2 for a, b in zip(line, line[1:]))
        score += 2 * sum((s[3] if groups[r] == s[2] else -s[3]) for r, s in pairs if groups[r] and s[2])
        if best is None or score > best[0] + 1e-9:
            best = (score, {r: s[0] for r, s in pairs}, known)
    return best


SITE, POINT = "k int, path_pos long, atom long, x double, y double, z double, grp int, conf double", "k int, residue_num long, atom long, x double, y double, z double"


@pytest.mark.parametrize("n_sites,length", [(2, 4), (4, 2), (3, 3), (0, 3), (6, 3)])
def test_repair_is_the_best_way(spark, n_sites, length):
    """Two anchors of four residues with ``length`` residues and ``n_sites`` sites between, before and after them."""
    rng = random.Random(n_sites * 10 + length)
    path, fixed, anchors, residue, place = [], [], [], 0, 0
    groups = {r: rng.choice((-1, 0, 1)) for r in range(1, 3 * length + 9)}
    point = lambda t: (6.0 * t + rng.uniform(-3, 3), rng.uniform(-4, 4), rng.uniform(-4, 4))
    for part in range(5):
        if part % 2 == 0:
            path += [(0, place + k, 100 + place + k, *point(residue + k), rng.choice((-1, 1)), 0.7) for k in range(n_sites)]
            residue, place = residue + length, place + n_sites
        else:
            anchors.append((0, residue + 1, residue + 4, place, 1))
            for k in range(4):
                p = point(residue + k + 1)
                path.append((0, place + k, 100 + place + k, *p, 1, 0.5))
                fixed.append((0, residue + k + 1, 100 + place + k, *p))
            residue, place = residue + 4, place + 4
    sizes = spark.createDataFrame([(0, place, residue)], "k int, n_path long, n_sequence long")
    anchor_rows = spark.createDataFrame(anchors, "k int, residue_start long, residue_end long, path_start long, direction int")
    fixed_rows = spark.createDataFrame(fixed, POINT)
    found = gaps.gap_candidates(anchor_rows, sizes, ["k"])
    problems = gaps.gap_problems(found, spark.createDataFrame(path, SITE), fixed_rows, spark.createDataFrame([(0, r, g) for r, g in groups.items()], "k int, residue_num long, grp int"), ["k"]).cache()
    repaired = gaps.repair_gaps(problems, ["k"]).cache()
    rows = {r["residue_num"]: r for r in repaired.collect()}
    known = {f[1]: f[3:] for f in fixed}
    for p in problems.collect():
        wanted = list(range(p["residue_lo"], p["residue_hi"] + 1))
        assert p["searched"] and p["ways"] == math.comb(max(n_sites, length), min(n_sites, length)) and p["n_sites"] == n_sites
        score, given, points = plain([(s["atom"], (s["x"], s["y"], s["z"]), s["grp"], s["conf"]) for s in p["sites"] or []], wanted, known, groups)
        for r in wanted:
            assert rows[r]["atom"] == given.get(r) and rows[r]["score"] == pytest.approx(score)
            assert [rows[r][a] for a in "xyz"] == pytest.approx(list(points[r]))
    whole = gaps.splice(fixed_rows, repaired, problems, spark.createDataFrame([(0, 1, 999)], "k int, residue_num long, atom long"), sizes, ["k"]).collect()
    assert sorted(r["residue_num"] for r in whole) == list(range(1, residue + 1))
    derived = sorted(r["atom"] for r in whole if r["source"] == "derived")
    assert derived == list(range(place, place + len(derived))) and not any(r["source"] == "baseline" for r in whole)


def test_gaps_that_are_not_searched(spark):
    anchors = spark.createDataFrame([(0, 1, 4, 0, 1), (0, 60, 63, 40, 1), (1, 5, 8, 10, -1), (1, 20, 23, 15, 1)], "k int, residue_start long, residue_end long, path_start long, direction int")
    sizes = spark.createDataFrame([(0, 44, 63), (1, 20, 23)], "k int, n_path long, n_sequence long")
    found = gaps.gap_candidates(anchors, sizes, ["k"])
    rows = sorted((r["k"], r["kind"], r["residue_lo"], r["residue_hi"], r["path_lo"], r["path_hi"]) for r in found.collect())
    assert rows == [(0, "internal", 5, 59, 4, 39)]  # key 1: directions differ, and its head would run over the other anchor
    path = spark.createDataFrame([(0, k, k, 6.0 * k, 0.0, 0.0, 0, 0.0) for k in range(44)], SITE)
    fixed = spark.createDataFrame([(0, 4, 3, 18.0, 0.0, 0.0)], POINT)
    problems = gaps.gap_problems(found, path, fixed, spark.createDataFrame([], "k int, residue_num long, grp int"), ["k"])
    row = problems.first()
    assert (row["n_sites"], row["n_residues"], row["searched"]) == (36, 55, False) and gaps.repair_gaps(problems, ["k"]).isEmpty()
    baseline = spark.createDataFrame([(0, 4, 77), (0, 5, 3), (0, 6, 5)], "k int, residue_num long, atom long")
    whole = gaps.splice(fixed, gaps.repair_gaps(problems, ["k"]), problems, baseline, sizes, ["k"]).collect()
    assert sorted((r["residue_num"], r["atom"], r["source"]) for r in whole) == [(4, 3, "anchor"), (6, 5, "baseline")]


def test_caps_are_residues(spark):
    own = [(0, 1, "A", "P", 0.0, 0.0, 0.0), (0, 1, "A", "OP1", 1.0, 1.0, 0.0), (0, 1, "A", "OP2", 1.0, -1.0, 0.0), (0, 1, "A", "O5'", 1.0, 0.0, 1.0), (0, 1, "A", "P5", 9.0, 9.0, 9.0), (1, 1, "HOH", "P", 0.0, 0.0, 0.0), (1, 1, None, "O", 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(own, "chain int, residue_num int, base string, atom string, x double, y double, z double")
    caps = restraints.add_caps(atoms, ["chain"])
    assert [(r["chain"], r["base"], r["atom"]) for r in caps.collect()] == [(0, "P5", "OP3")]
    assert restraints.strip_caps(atoms.unionByName(caps)).count() == len(own)


def test_spliced_sites_equal_plain_version(spark):
    """Anchored sites, then repaired gaps with numbers for derived points, then what is left of the plain assignment."""
    from latticeworks.jobs import structure_jobs

    sf = "/root/testdata/sf0.001"
    c, fixed, sizes, problems, repaired = structure_jobs._repaired(spark, sf)
    where = {(r["chain"], r["id"]): (r["x"], r["y"], r["z"]) for r in c.collect()}
    expected, used = {}, set()
    for r in fixed.collect():
        expected[r["chain"], r["residue_num"]] = (r["atom"], "anchor", where[r["chain"], r["atom"]])
        used.add((r["chain"], r["atom"]))
    rows = sorted(repaired.collect(), key=lambda r: (r["chain"], r["gap"], r["residue_num"]))
    number = {r["chain"]: r["n_path"] for r in sizes.collect()}
    for r in rows:
        if r["atom"] is None:
            expected[r["chain"], r["residue_num"]] = (number[r["chain"]], "derived", (r["x"], r["y"], r["z"]))
            number[r["chain"]] += 1
        else:
            expected[r["chain"], r["residue_num"]] = (r["atom"], "repaired", where[r["chain"], r["atom"]])
        used.add((r["chain"], expected[r["chain"], r["residue_num"]][0]))
    done = {(r["chain"], r["gap"]) for r in rows}
    for r in problems.collect():
        if (r["chain"], r["gap"]) in done:
            used |= {(r["chain"], s["atom"]) for s in r["sites"] or []}
    for r in c.collect():
        if (r["chain"], r["residue_num"]) not in expected and (r["chain"], r["id"]) not in used:
            expected[r["chain"], r["residue_num"]] = (r["id"], "baseline", where[r["chain"], r["id"]])
    got = {(r["chain"], r["residue_num"]): r for r in structure_jobs.spliced_sites(spark, sf).collect()}
    assert set(got) == set(expected)
    for key, (atom, source, place) in expected.items():
        r = got[key]
        assert (r["atom"], r["source"]) == (atom, source), key
        assert all(abs(r[a] - v) < 1e-5 for a, v in zip("xyz", place, strict=True))
    assert {"anchor", "repaired", "derived"} <= {e[1] for e in expected.values()}
