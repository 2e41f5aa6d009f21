"""The ancestor closure of deep hierarchies and of cycles."""

from stratalens.operators import graph


def test_ancestors_of_any_depth(spark):
    """A chain of 67 links, whose end lies in a cycle of three."""
    links = [*((i, i + 1) for i in range(66)), (66, 64)]
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestor_closure(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = {}
    after = dict(links)
    for i in after:
        at, depth = after[i], 1
        while at != i and (i, at) not in want:
            want[i, at] = depth
            at, depth = after[at], depth + 1
    assert want[0, 66] == 66 and got == want
