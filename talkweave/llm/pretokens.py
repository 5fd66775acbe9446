"""Word cutting of byte-level BPE vocabularies as a finite transducer run by parallel prefix scan.

The cutting rule is the published one of these vocabularies: contractions
('s 't 're 've 'm 'll 'd), an optional space before letters, digits or other
marks, and runs of white space of which the last character goes to what follows.
Its two characters of look-ahead are folded into the input symbols, so that the
rule becomes a deterministic transducer with nine states whose transitions say
whether a new piece begins.  A text is dealt into chunks; each chunk's map from
entry state to exit state is computed for all chunks at once, the maps are
composed by a doubling scan, and a second run from the then known entry states
writes the cuts.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Input symbols.
MARK, SHORT, LONG, LETTER, DIGIT, SPACE, SINGLE, RUN, SPECIAL, INSIDE = range(10)
SYMBOLS = 10
#: States: between pieces, in letters, in digits, in marks, after a leading space, in white space, one or two characters left of a contraction, in a special token.
CUT, IN_LETTERS, IN_DIGITS, IN_MARKS, LED, IN_SPACE, ONE_LEFT, TWO_LEFT, IN_SPECIAL = range(9)
STATES = 9
CHUNK = 256


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here" by state and symbol; symbols from SYMBOLS on restart the machine first."""
    fresh = {MARK: IN_MARKS, SHORT: ONE_LEFT, LONG: TWO_LEFT, LETTER: IN_LETTERS, DIGIT: IN_DIGITS, SPACE: LED, SINGLE: CUT, RUN: IN_SPACE, SPECIAL: IN_SPECIAL, INSIDE: IN_SPECIAL}
    after = np.empty((STATES, 2 * SYMBOLS), np.uint8)
    begins = np.ones((STATES, 2 * SYMBOLS), bool)
    after[:] = [fresh[s % SYMBOLS] for s in range(2 * SYMBOLS)]
    stays = [(IN_LETTERS, LETTER), (IN_DIGITS, DIGIT), (IN_SPACE, RUN), (IN_SPECIAL, INSIDE), *((state, s) for state in (IN_MARKS, LED) for s in (MARK, SHORT, LONG)), (LED, LETTER), (LED, DIGIT)]
    for state, s in stays:
        begins[state, s] = False
        after[state, s] = IN_MARKS if s in (MARK, SHORT, LONG) else fresh[s]
    for state, then in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, CUT)):
        begins[state, :SYMBOLS], after[state, :SYMBOLS] = False, then
    return after, begins


AFTER, BEGINS = _machine()


# Letters and digits that Unicode 16.0 added to those of Python's own table (15.1).
NEW_LETTERS = """
1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E
11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0
"""
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, DIGIT, RUN (white space) or MARK of every code point."""
    kinds = {"L": LETTER, "N": DIGIT, "Z": RUN}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(0x110000)], np.uint8)
    out[[*range(0x09, 0x0E), 0x85]] = RUN
    for ranges, symbol in ((NEW_LETTERS, LETTER), (NEW_DIGITS, DIGIT)):
        for low, high in (r.split("-") for r in ranges.split()):
            out[int(low, 16) : int(high, 16) + 1] = symbol
    return out


def _symbols(points: np.ndarray, first: np.ndarray, special: np.ndarray, length: int) -> np.ndarray:
    """Input symbols of code points; first: positions where texts begin; special: where special tokens of ``length`` begin."""
    n = len(points)
    sym = _classes()[points]
    stop = np.zeros(n + 3, bool)  # nothing is looked up from here on
    stop[first] = True
    stop[n:] = True
    stop[special] = True
    ahead = np.zeros(n + 2, points.dtype)
    ahead[:n] = points
    white = sym == RUN
    next_white = np.zeros(n, bool)
    next_white[:-1] = white[1:]
    alone = white & ~next_white & ~stop[1 : n + 1]
    sym[alone] = np.where(points[alone] == 0x20, SPACE, SINGLE)
    quote = np.flatnonzero((points == 0x27) & ~stop[1 : n + 1])
    a, b = ahead[quote + 1], ahead[quote + 2]
    pair = ~stop[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    sym[quote[pair]] = LONG
    sym[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    for k in range(length):
        sym[special + k] = INSIDE if k else SPECIAL
    sym[first[first < n]] += SYMBOLS
    return sym


def scan(sym: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin: chunk maps, their composition by doubling, and the run from known states."""
    n = len(sym)
    count = -(-n // chunk)
    grid = np.full(count * chunk, MARK, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(count, chunk).T)
    after, width = AFTER.ravel(), 2 * SYMBOLS
    maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], count, 1)
    for k in range(chunk):
        if k % 8 == 0 and (maps == maps[0]).all():  # every entry state has led to the same one
            one = maps[0].copy()
            for j in range(k, chunk):
                one = after[one * width + grid[j]].astype(np.intp)
            maps = np.broadcast_to(one, maps.shape).copy()
            break
        maps = after[maps * width + grid[k]].astype(np.intp)
    step = 1
    while step < count:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
        step *= 2
    state = np.zeros(count, np.intp)
    state[1:] = maps[CUT, :-1]
    begins, cuts = BEGINS.ravel(), np.empty((chunk, count), bool)
    for k in range(chunk):
        at = state * width + grid[k]
        cuts[k] = begins[at]
        state = after[at].astype(np.intp)
    return np.ascontiguousarray(cuts.T).ravel()[:n]


def pretokens(data: np.ndarray, at: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pieces begin (and the end of the last), and the number of pieces of each row.

    data, at: the UTF-8 bytes of the rows and each row's start (see ``text.buffers``).
    special: a special token whose string is a piece of its own wherever it occurs in a row.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(at) - 1, np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    found: list[int] = []
    if special:
        k = raw.find(special)
        while k >= 0:
            row = int(np.searchsorted(at, k, "right")) - 1
            if k + len(special) <= at[row + 1]:
                found.append(k)
                k = raw.find(special, k + len(special))
            else:
                k = raw.find(special, k + 1)
    first = np.searchsorted(start, np.unique(at[:-1][np.diff(at) > 0]))
    cuts = scan(_symbols(points, first, np.searchsorted(start, np.array(found, np.int64)), len(special)))
    begin = start[cuts]
    return np.append(begin, len(data)), np.diff(np.searchsorted(begin, at))
