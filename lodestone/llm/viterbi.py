"""Cheapest edits that make the turns of a conversation alternate, for many stretches of turns at once.

A turn is a code: twice the place of its role's initial in `INITIALS` (3: any other) plus 1 if its text is cut off, or `GONE` if it has
to go. What has been kept so far is one of four states: nothing, a system turn, an open pair (user), a closed pair (assistant). A cost
vector says what the rest costs from each state. Vectors that differ by a constant only ask for the same edits, so they are kept with a
least entry of 0, and there are few of them (`packed` numbers them).
"""

from __future__ import annotations

import numpy as np

INITIALS = "sua"
GONE, NOTHING = 8, 9
DELETE, INSERT, REROLE = 3, 2, 2
START, SYSTEM, OPEN, CLOSED = range(4)
STATES = 4
_FAR = 1 << 40
#: The state after a role's initial, or -1: `(s?(ua)+)?`.
AFTER = np.full((STATES, 4), -1)
AFTER[START, 0] = SYSTEM
AFTER[[START, SYSTEM, CLOSED], 1] = OPEN
AFTER[OPEN, 2] = CLOSED
#: The state after a turn of the one role that an edit can give there, and that role.
FILLED = np.array([OPEN, OPEN, CLOSED, OPEN])
ROLES = ("user", "user", "assistant", "user")


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs from each state (rows) when turns may be inserted first."""
    out = costs
    for _ in range(STATES):
        out = np.minimum(out, INSERT + out[FILLED])
    return out


def _steps() -> np.ndarray:
    """For each code, what it costs to come from a state (row) to a state (column) over one turn."""
    steps = np.full((NOTHING + 1, STATES, STATES), _FAR, np.int64)
    every = np.arange(STATES)
    for code in range(GONE):
        initial, cut = divmod(code, 2)
        steps[code, every, every] = DELETE
        steps[code, every, FILLED] = np.minimum(steps[code, every, FILLED], REROLE + cut)
        fits = AFTER[:, initial] >= 0
        steps[code, every[fits], AFTER[fits, initial]] = cut
        steps[code] = _closed(steps[code])
    steps[GONE, every, every] = DELETE
    steps[GONE] = _closed(steps[GONE])
    steps[NOTHING, every, every] = 0
    return steps


STEPS = _steps()
#: After the last turn: nothing or a closed pair is whole, else turns are inserted.
TERMINAL = _closed(np.array([0, _FAR, _FAR, 0], np.int64))
#: Vectors that stretches start from before the true ones are known: the end, and the borders of regular pairs.
GUESSES = (TERMINAL, np.array([0, 0, 2, 0]), np.array([2, 2, 0, 2]))


def normal(vectors: np.ndarray) -> np.ndarray:
    return vectors - vectors.min(axis=-1, keepdims=True)


def packed(vector: np.ndarray) -> int:
    """A number for a vector and all that differ from it by a constant."""
    return int(sum(int(v) << 8 * i for i, v in enumerate(normal(np.asarray(vector)))))


def unpacked(number: int) -> np.ndarray:
    return np.array([number >> 8 * i & 255 for i in range(STATES)], np.int64)


def buckets(sizes: list[int], most: int = 1 << 18):
    """Indices of stretches of similar length, few enough that their padded turns are at most about `most`."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, 2 * sizes[order[at]])
        end = at + 1
        while end < len(order) and sizes[order[end]] <= longest and (end - at) * sizes[order[end]] < most:
            end += 1
        yield order[at:end].tolist()
        at = end


def padded(codes: list[np.ndarray], runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and how many turns each stands for, as matrices; short rows end in turns that are nothing."""
    width = max(map(len, codes))
    table, count = np.full((len(codes), width), NOTHING, np.uint8), np.ones((len(codes), width), np.int64)
    for i, (c, r) in enumerate(zip(codes, runs, strict=True)):
        table[i, : len(c)], count[i, : len(r)] = c, r
    return table, count


def backward(codes: np.ndarray, runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost vectors before each turn and after the last (turn, stretch, state), from the vectors after the last one."""
    costs = np.empty((codes.shape[1] + 1, *ends.shape), np.int64)
    costs[-1] = ends
    for j in range(codes.shape[1] - 1, -1, -1):
        costs[j] = (STEPS[codes[:, j]] + costs[j + 1][:, None, :]).min(axis=2) + DELETE * (runs[:, j, None] - 1)
    return costs


def fronts(codes: np.ndarray, guesses: np.ndarray) -> np.ndarray:
    """The vector before each stretch for each guess of the one after it (stretch, guess, state), less constants.

    All guesses of a stretch go on together; one that has come to differ from an earlier one by a constant only goes on as that one.
    """
    stretches, kinds = len(codes), len(guesses)
    row = np.repeat(np.arange(stretches), kinds)
    vectors = normal(np.tile(guesses, (stretches, 1)))
    leader = np.arange(stretches * kinds)
    live = leader.copy()
    for j in range(codes.shape[1] - 1, -1, -1):
        vectors[live] = normal((STEPS[codes[row[live], j]] + vectors[live][:, None, :]).min(axis=2))
        if j % 8 == 0 and len(live) > stretches:
            marks = row[live] << 32 | vectors[live] @ (1 << 8 * np.arange(STATES))
            _, first, kind = np.unique(marks, return_index=True, return_inverse=True)
            leader[live] = live[first[kind]]
            live = live[np.sort(first)]
    while not np.array_equal(leader, leader[leader]):
        leader = leader[leader]
    return vectors[leader].reshape(stretches, kinds, STATES)


def trace(codes: np.ndarray, runs: np.ndarray, costs: np.ndarray, starts: np.ndarray, final: np.ndarray):
    """Least letters of cheapest edits, from each start state: (stretch, start, letter; 0 is none), and the last states.

    Four letters to a turn: up to three insertions and its own edit. At the end of a `final` stretch open pairs are closed.
    """
    n, width = codes.shape
    letters = np.zeros((n, starts.shape[1], 4 * width + 3), np.uint8)
    state, at = starts.copy(), np.arange(n)[:, None]

    def insert(where, slot):
        letters[:, :, slot][where] = ord("I")
        return np.where(where, FILLED[state], state)

    for j in range(width):
        code, run = codes[:, j, None], runs[:, j, None]
        real, now, then = code != NOTHING, costs[j], costs[j + 1]
        for slot in range(3):
            deleted = DELETE * run + then[at, state] == now[at, state]
            state = insert(real & ~deleted & (INSERT + now[at, FILLED[state]] == now[at, state]), 4 * j + slot)
        need = now[at, state]
        deleted = DELETE * run + then[at, state] == need
        kept_as = AFTER[state, np.minimum(code >> 1, 3)]
        kept = ~deleted & (kept_as >= 0) & ((code & 1) + then[at, kept_as] == need)
        letter = np.where(deleted, ord("D"), np.where(kept, ord("K"), ord("R")))
        letters[:, :, 4 * j + 3] = np.where(real, letter, 0)
        state = np.where(real & ~deleted, np.where(kept, kept_as, FILLED[state]), state)
    for slot in range(3):
        state = insert(final[:, None] & (costs[-1][at, state] > 0), 4 * width + slot)
    return letters, state


def spelled(letters: np.ndarray, runs: np.ndarray) -> str:
    """The letters of one stretch as text, a deletion as often as its turn stands for several."""
    times = (letters != 0).astype(np.int64)
    own = letters[3 : 4 * len(runs) : 4]
    times[3 : 4 * len(runs) : 4] *= np.where(own == ord("D"), runs, 1)
    return np.repeat(letters, times).tobytes().decode()
