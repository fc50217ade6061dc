"""Hand-judged result lists: query, and the grades (0 to 3) of the first five results of three systems."""

from __future__ import annotations

#: Fixed values.
JUDGMENTS = [
    ('football', [3, 3, 2, 2, 1], [3, 3, 3, 2, 2], [3, 3, 2, 2, 2]),
    ('basketball', [3, 2, 2, 1, 1], [3, 3, 2, 2, 1], [3, 3, 2, 2, 1]),
    ('tennis', [3, 2, 2, 1, 0], [3, 3, 2, 1, 1], [3, 3, 2, 2, 1]),
    ('world cup', [3, 3, 2, 1, 1], [3, 3, 3, 2, 2], [3, 3, 3, 2, 2]),
    ('olympic games', [3, 3, 2, 2, 1], [3, 3, 3, 2, 1], [3, 3, 3, 2, 2]),
    ('ice hockey', [3, 2, 2, 1, 0], [3, 3, 2, 2, 1], [3, 3, 2, 2, 1]),
    ('figure skating', [3, 3, 2, 1, 1], [3, 3, 2, 2, 2], [3, 3, 3, 2, 1]),
    ('marathon running', [3, 2, 1, 1, 0], [3, 3, 2, 2, 1], [3, 3, 2, 2, 2]),
    ('wimbledon championship', [3, 2, 1, 0, 0], [3, 3, 2, 1, 1], [3, 3, 3, 2, 1]),
    ('tour de france', [3, 3, 2, 1, 0], [3, 3, 3, 2, 1], [3, 3, 3, 2, 2]),
    ('super bowl history', [3, 2, 1, 0, 0], [3, 2, 2, 1, 1], [3, 3, 2, 2, 1]),
    ('formula one racing', [3, 2, 1, 0, 0], [3, 3, 2, 1, 0], [3, 3, 2, 2, 1]),
    ('NBA finals', [3, 2, 1, 0, 0], [3, 3, 2, 2, 1], [3, 3, 3, 2, 1]),
    ('goal', [2, 1, 1, 0, 0], [2, 2, 1, 1, 0], [3, 2, 1, 1, 0]),
    ('match', [1, 1, 0, 0, 0], [2, 1, 1, 0, 0], [2, 1, 1, 0, 0]),
    ('champion league winner', [2, 1, 1, 0, 0], [3, 2, 1, 1, 0], [3, 2, 2, 1, 0]),
    ('football && referee', [3, 2, 1, 1, 0], [2, 2, 1, 0, 0], [3, 2, 2, 1, 1]),
    ('basketball || volleyball', [3, 3, 2, 2, 2], [3, 3, 2, 2, 1], [3, 3, 3, 2, 2]),
    ('swimming && !relay', [2, 2, 1, 1, 0], [1, 1, 1, 0, 0], [2, 2, 1, 1, 0]),
    ('(football || rugby) && world', [3, 2, 2, 1, 0], [3, 2, 2, 1, 1], [3, 3, 2, 1, 1]),
    ('"penalty shootout"', [3, 3, 2, 1, 1], [3, 3, 2, 2, 1], [3, 3, 3, 2, 2]),
    ('"gold medal"', [3, 2, 2, 1, 0], [3, 3, 2, 1, 1], [3, 3, 2, 2, 1]),
    ('"hat trick"', [3, 2, 1, 1, 0], [3, 2, 2, 1, 1], [3, 3, 2, 1, 1]),
    ('"doping scandal" / 5', [2, 2, 1, 0, 0], [3, 2, 1, 1, 0], [3, 2, 2, 1, 1]),
    ('"world record" / 3', [3, 2, 1, 0, 0], [3, 2, 2, 1, 0], [3, 3, 2, 1, 1]),
    ('who won the first world cup', [2, 1, 0, 0, 0], [3, 2, 1, 1, 0], [3, 3, 2, 1, 1]),
    ('fastest runner in the world', [2, 1, 1, 0, 0], [3, 2, 2, 1, 0], [3, 3, 2, 2, 1]),
    ('most olympic gold medals', [2, 1, 1, 0, 0], [3, 3, 2, 1, 0], [3, 3, 3, 2, 1]),
    ('"champions league" && final', [3, 2, 1, 0, 0], [3, 2, 1, 1, 0], [3, 2, 2, 1, 1]),
    ('(boxing || wrestling) && heavyweight', [2, 2, 1, 0, 0], [3, 2, 1, 1, 0], [3, 2, 2, 1, 0]),
]
