"""Deterministic transducers over character classes, run chunk by chunk: state maps compose by a parallel prefix scan.

A text is cut into chunks of equal length. For every chunk, all start states advance in step, which gives a map from
the state before the chunk to the state after it. The maps compose associatively, so a doubling scan over chunks
yields the state in which each chunk truly begins, and a second pass emits from there.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Characters of a chunk.
CHUNK = 128
#: Classes of characters. RESET stands between texts.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, E, L, RESET = range(12)
#: Emissions: a piece starts at this character, at the one before, at both.
HERE, BEFORE = 1, 2


@cache
def class_table() -> np.ndarray:
    """Class by code point: Unicode's White_Space, letters (L*), numbers (N*) and the letters of the contractions."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        for x in letters:
            table[ord(x)] = kind
    return table


class Splitter:
    """A pre-tokenizer's pattern as a transducer from character classes to the places where pieces start.

    joined=False: contractions, letter runs, single numbers, runs of others; white space is dropped.
    joined=True: contractions, letter, number and other runs with one space before them, runs of white space.
    """

    STATES = ("begin", "word", "digits", "mark", "quote", "quote_r", "quote_v", "quote_l", "space", "blank")

    def __init__(self, joined: bool):
        n = {x: i for i, x in enumerate(self.STATES)}
        self.next = np.zeros((len(n), 12), np.uint8)
        self.out = np.zeros((len(n), 12), np.uint8)
        self.joined = joined
        for name, state in n.items():
            for kind in range(12):
                to, out = self._step(name, kind)
                self.next[state, kind], self.out[state, kind] = n[to], out

    def _step(self, state: str, kind: int) -> tuple[str, int]:
        # an apostrophe (with r, v or l) that began a piece: a contraction now, or the letter began a word
        late = 0
        if state in ("quote_r", "quote_v", "quote_l"):
            if kind == {"quote_r": E, "quote_v": E, "quote_l": L}[state]:
                return "begin", 0
            state, late = "word", BEFORE
        if state == "quote":
            if kind == STMD:
                return "begin", 0
            if kind in (R, V, L):
                return {R: "quote_r", V: "quote_v", L: "quote_l"}[kind], 0
            state = "mark"
        if kind == RESET:
            return "begin", late
        letter = kind in (LETTER, STMD, R, V, E, L)
        if kind in (SPACE, BLANK):
            if not self.joined:
                return "begin", late
            return ("space" if kind == SPACE else "blank"), late | (0 if state in ("space", "blank") else HERE)
        led = state == "space"
        if led:  # the last space of a run goes with what follows
            late |= BEFORE
        elif state == "blank":
            late |= BEFORE | HERE
        if letter:
            return "word", late | (0 if state == "word" or led else HERE)
        if kind == NUMBER:
            if not self.joined:
                return "begin", late | HERE
            return "digits", late | (0 if state == "digits" or led else HERE)
        if kind == QUOTE and state != "mark" and not led:
            return "quote", late | HERE
        return "mark", late | (0 if state == "mark" or led else HERE)

    def split(self, text: str, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of text; the characters at resets stand between texts and belong to none."""
        kinds = class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kinds[resets] = RESET
        n = len(kinds)
        lanes = -(-(n + 1) // CHUNK)
        steps = np.full(lanes * CHUNK, RESET, np.uint8)
        steps[:n] = kinds
        steps = np.ascontiguousarray(steps.reshape(lanes, CHUNK).T)
        following, states = self.next.ravel(), len(self.STATES)
        row = np.uint8(12)
        maps = np.repeat(np.arange(states, dtype=np.uint8)[:, None], lanes, axis=1)
        for kind in steps:
            maps = following[maps * row + kind]
        maps = np.ascontiguousarray(maps.T)
        width = 1
        while width < lanes:  # after each round, maps[i] covers the 2 * width chunks that end with i
            maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
            width *= 2
        state = np.concatenate(([0], maps[:-1, 0])).astype(np.uint8)
        emitted = np.empty_like(steps)
        outs = self.out.ravel()
        for j, kind in enumerate(steps):
            at = state * row + kind
            emitted[j], state = outs[at], following[at]
        emitted = emitted.T.ravel()[: n + 1]
        first = (emitted & HERE) > 0
        first[:-1] |= (emitted[1:] & BEFORE) > 0
        first = first[:n]
        stop = first | (kinds == RESET)
        if not self.joined:
            stop |= kinds <= BLANK
        starts, stops = np.flatnonzero(first), np.append(np.flatnonzero(stop), n)
        return starts, stops[np.searchsorted(stops, starts, side="right")]
