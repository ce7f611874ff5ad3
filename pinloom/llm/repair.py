"""Re-Pair grammars over token sequences, for many files at once.

Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair repeats. Here every round replaces, in
every file, all pairs at least half as frequent as the file's most frequent one, rather than that one alone; where candidates
overlap, the more frequent wins. A rule is named by a hash of its right side, so that equal rules of different files are the same rule. What a file's
grammar looks like depends on that file alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT, _LOW = np.uint64(31), np.uint64((1 << 40) - 1)



def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * _A + (b ^ (b >> _SHIFT)) * _B) ^ _C
        x = (x ^ (x >> _SHIFT)) * _A
        return x ^ (x >> np.uint64(29))


@dataclass
class Grammars:
    """Per file: tokens, length of the start rule, number of rules; and the rules as (file, rule, symbols it spans, uses)."""

    tokens: np.ndarray
    start: np.ndarray
    rules: np.ndarray
    rule_file: np.ndarray
    rule: np.ndarray
    span: np.ndarray
    uses: np.ndarray
    #: The name of each start rule, a hash of its symbols; equal sequences have equal names.
    start_rule: np.ndarray

    def size(self) -> np.ndarray:
        """Symbols on the right sides of each grammar as a part of the file's tokens."""
        return (self.start + 2 * self.rules) / np.maximum(self.tokens, 1)


def induce(sequences: list[np.ndarray]) -> Grammars:
    """The grammars of token sequences (64-bit hashes of tokens)."""
    count = len(sequences)
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    symbols = np.concatenate(sequences).astype(np.uint64) if count else np.zeros(0, np.uint64)
    file = np.repeat(np.arange(count), lengths)
    span = np.ones(len(symbols), dtype=np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    start = lengths.copy()
    start_rule = np.zeros(count, np.uint64)

    def close(done: np.ndarray) -> None:
        """Names the start rules of the files that ``done`` marks."""
        at = np.flatnonzero(done[file])
        if len(at):
            heads = np.flatnonzero(np.append(True, file[at][1:] != file[at][:-1]))
            place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            with np.errstate(over="ignore"):
                start_rule[file[at[heads]]] = np.add.reduceat(mixed(symbols[at], place.astype(np.uint64)), heads)

    every = np.ones(count, dtype=bool)
    while True:
        if len(symbols) < 2:
            close(every)
            break
        inner = file[1:] == file[:-1]
        pair = mixed(symbols[:-1], symbols[1:])
        # a pair across two files counts for neither
        keyed = np.where(inner, mixed(pair, file[:-1].astype(np.uint64)), np.uint64(0))
        inverse, _ = pd.factorize(keyed)
        times = np.where(inner, np.bincount(inverse)[inverse], 0)
        most = np.zeros(count, dtype=np.int64)
        np.maximum.at(most, file[:-1], times)
        candidate = inner & (times >= np.maximum(2, (most[file[:-1]] + 1) // 2))
        if not candidate.any():
            close(every)
            break
        weight = np.where(candidate, (times.astype(np.uint64) << np.uint64(40)) | (pair & _LOW), np.uint64(0))
        before, after = np.concatenate([[np.uint64(0)], weight[:-1]]), np.concatenate([weight[1:], [np.uint64(0)]])
        # within a run of one pair (aaaa) every other place is taken
        same = candidate & (weight == before) & (pair == np.concatenate([[np.uint64(0)], pair[:-1]]))
        place = np.arange(len(weight))
        head = np.maximum.accumulate(np.where(~same, place, 0))
        taken = candidate & (weight >= before) & (weight >= after) & ((place - head) % 2 == 0)
        taken[1:] &= ~(taken[:-1] & ~same[1:] & (weight[1:] == before[1:]))
        # an end of a run may still touch a place of equal weight
        clash = taken[1:] & taken[:-1]
        taken[1:][clash] = False
        if not taken.any():
            close(every)
            break
        at = np.flatnonzero(taken)
        code, distinct = pd.factorize(keyed[at])
        uses = np.bincount(code)
        first = np.empty(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        where = at[first]
        found.append((file[where], pair[where], span[where] + span[where + 1], uses))
        symbols[at] = pair[at]
        span[at] += span[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        # files without a repeated pair are finished and leave the arrays
        live = most[file] >= 2
        sizes = np.bincount(file[keep], minlength=count)
        present = np.zeros(count, dtype=bool)
        present[file] = True
        start[present] = sizes[present]
        live = live[keep]
        symbols, file, span = symbols[keep], file[keep], span[keep]
        close(most < 2)
        symbols, file, span = symbols[live], file[live], span[live]
    if found:
        rule_file, rule, spans, uses = (np.concatenate(x) for x in zip(*found))
    else:
        rule_file, rule, spans, uses = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Grammars(lengths, start, np.bincount(rule_file, minlength=count) if count else np.zeros(0, np.int64), rule_file, rule, spans, uses, start_rule)
