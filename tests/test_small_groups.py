"""Small groups are solved without paths through them, with the same choice."""

import random

import pytest

from duskline.functions import assignment as asg


def plain(edges):
    """Groups by spreading from edge to edge."""
    left, groups = sorted(edges), []
    while left:
        group, at = [left.pop(0)], 0
        while at < len(group):
            near = [e for e in left if e[0] == group[at][0] or e[1] == group[at][1]]
            left = [e for e in left if e not in near]
            group, at = group + near, at + 1
        groups.append(sorted(group))
    return sorted(groups)


@pytest.mark.parametrize("weights", [None, (0.1, 0.2, 0.1 + 0.2, 0.3, 0.7)])
def test_groups_and_choices(weights):
    rng = random.Random(3)
    for _ in range(1_500):
        all_of = [(r, c, rng.choice(weights) if weights else rng.random()) for r in range(5) for c in range(5) if rng.random() < 0.3]
        rng.shuffle(all_of)
        groups = asg.connected(all_of)
        assert sorted(groups) == plain(all_of)
        for g in groups:
            assert sorted(asg.best_of(g)) == sorted(asg._fill(g)) or len({e[0] for e in g}) == 1 or len({e[1] for e in g}) == 1
        square = [(r, c, rng.choice(weights) if weights else rng.random()) for r in (3, 5) for c in (1, 2)]
        assert sorted(asg.best_of(square)) == sorted(asg._fill(square))


def test_two_by_two_takes_no_paths(monkeypatch):
    monkeypatch.setattr(asg, "_fill", None)
    assert sorted(asg.best_of([(0, 0, 0.9), (0, 1, 0.5), (1, 0, 0.8), (1, 1, 0.1)])) == [1, 2]
    assert asg.best_of([(0, 4, 0.5), (3, 4, 0.5)]) == [0]
    with pytest.raises(TypeError):  # a tie up to rounding is decided in whole numbers
        asg.best_of([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5)])
