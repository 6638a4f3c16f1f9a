"""``collapse_ephemeral`` against a union-find on chains longer than any fixed number of rounds, and on loops."""

from auditloom.operators import regularity


def union_find(parents, short):
    """Top of each short node; a loop's top is its least node."""
    out = {}
    for node in short & set(parents):
        path, at = [node], node
        while at in short and at in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        loop = at in short and at in parents
        out[node] = min(path[path.index(parents[at]):]) if loop else at
    return {n: t for n, t in out.items() if n != t}


def test_long_chains_and_loops_reach_one_target(spark):
    parents = {f"c{i:03}": f"c{i - 1:03}" for i in range(1, 150)} | {"c000": "top"}
    parents |= {f"d{i:03}": f"d{i - 1:03}" for i in range(1, 70)}  # its top is short too
    parents |= {f"l{i}": f"l{(i + 1) % 7}" for i in range(7)}
    parents |= {f"m{i:02}": f"m{i - 1:02}" for i in range(1, 50)} | {"m00": "l3"}  # runs into the loop
    short = set(parents) | {"d000"}
    rows = [(0, n, "file") for n in sorted(short)] + [(b, "top", "file") for b in range(5)]
    events = spark.createDataFrame(rows, "bin long, src string, dst string")
    lookup = spark.createDataFrame([(n, p, "PROCESS") for n, p in parents.items()], "node string, parent string, role string")
    out, moved = regularity.collapse_ephemeral(events, lookup, 3)
    got = {r["node"]: r["target"] for r in moved.collect()}
    assert got == union_find(parents, short)
    assert {got[n] for n in parents if n[0] == "c"} == {"top"} and {got[n] for n in parents if n[0] == "m"} == {"l0"}
    assert {r["src"] for r in out.select("src").collect()} == {"top", "d000", "l0"}
