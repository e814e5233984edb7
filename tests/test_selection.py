"""Every reason why a selection cannot be fused, and their order."""

from helpers import outline, square, vertices
from inkgrid.operators import union

PIECES = "selection_id long, doc_id long, pos int, component_id string"
MEMBERS = "selection_id long, doc_id long, component_id string, path_index int, subpath_index int, role string"


def test_all_reasons(spark):
    v = vertices(
        spark, outline(1, 0, square(0, 0, 10)), outline(1, 1, square(20, 0, 10)), outline(1, 2, [(0, 0), (10, 10), (10, 0), (0, 10)]), outline(1, 3, [(0, 0), (5, 5)]), outline(1, 4, [(0, 0), (5, 0), (9, 0)]),
        outline(1, 5, square(2, 2, 3)))
    cases = {  # components of the selection, members by component (path, role)
        None: (["a", "b"], {"a": [(0, "solid"), (5, "hole")], "b": [(1, "solid")]}),
        "too_few_pieces": (["a"], {"a": [(0, "solid")]}),
        "repeated_pieces": (["a", "a"], {"a": [(0, "solid")]}),
        "empty_piece": (["a", "b"], {"a": [(0, "solid")]}),
        "shared_member": (["a", "b"], {"a": [(0, "solid")], "b": [(0, "solid"), (1, "solid")]}),
        "missing_member": (["a", "b"], {"a": [(0, "solid")], "b": [(9, "solid")]}),
        "too_few_points": (["a", "b"], {"a": [(0, "solid")], "b": [(3, "solid")]}),
        "invalid_ring": (["a", "b"], {"a": [(0, "solid")], "b": [(2, "solid")]}),
        "no_solid": (["a", "b"], {"a": [(0, "solid")], "b": [(5, "hole")]}),
    }
    wanted = {k: reason for k, reason in enumerate(cases)}
    # more than one fault: the first in the fixed order is told
    extra = {100: ("missing_member", (["a", "b"], {"a": [(9, "solid")], "b": [(2, "hole")]})), 101: ("invalid_ring", (["a", "b"], {"a": [(4, "solid")], "b": [(1, "solid")]})),
             102: ("repeated_pieces", (["a", "a", "b"], {"a": [(0, "solid"), (0, "solid")]}))}
    every = {k: case for k, case in enumerate(cases.values())} | {k: case for k, (_, case) in extra.items()}
    wanted |= {k: reason for k, (reason, _) in extra.items()}
    pieces = [(k, 1, n, c) for k, (chosen, _) in every.items() for n, c in enumerate(chosen)]
    members = [(k, 1, c, path, 0, role) for k, (_, held) in every.items() for c, parts in held.items() for path, role in parts]
    rows = union.validate_selection(spark.createDataFrame(pieces, PIECES), spark.createDataFrame(members, MEMBERS), v).collect()
    assert {r.selection_id: r.reason for r in rows} == wanted
