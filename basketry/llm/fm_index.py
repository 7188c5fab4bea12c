"""A compressed full-text index over sequences of words: suffix order, Burrows-Wheeler transform, wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of numbers below ``size``, one bit vector per binary digit."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.digits = max(1, int(size - 1).bit_length())
        self.levels: list[Bits] = []
        begin = np.zeros(size, dtype=np.int64)  # where a number's stretch begins after the last level
        numbers = np.arange(size)
        for d in range(self.digits - 1, -1, -1):
            bit = (sequence >> d & 1).astype(bool)
            level = Bits(bit)
            self.levels.append(level)
            begin = np.where(numbers >> d & 1, level.zeros + level.rank(begin), begin - level.rank(begin))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        self.begin = begin

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before each position."""
        out = at
        for d, level in zip(range(self.digits - 1, -1, -1), self.levels):
            ones = level.rank(out)
            out = np.where(number >> d & 1, level.zeros + ones, out - ones)
        return out - self.begin[number]


class FMIndex:
    """Passages of words, searched backwards. Each place has its passage's label; places whose next
    ``threshold`` words are equal form a group with the least label among them.

    ``words``: all passages one after the other, numbers below ``size``.
    ``lengths``: of the passages. ``labels``: one per passage.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, labels: np.ndarray, size: int, threshold: int):
        count = len(lengths)
        ends = np.cumsum(lengths) + np.arange(count)  # a separator behind each passage
        total = len(words) + count
        separator = np.zeros(total, dtype=bool)
        separator[ends] = True
        # separators differ from each other and come before all words
        rank = np.empty(total, dtype=np.int64)
        rank[separator] = np.arange(count)
        rank[~separator] = words + count
        rank = np.unique(rank, return_inverse=True)[1]
        depth, order = 1, np.argsort(rank, kind="stable")
        same = [(1, rank.astype(np.int32))]  # places with equal numbers have so many words in common
        while total and rank[order[-1]] < total - 1:
            ahead = np.zeros(total, dtype=np.int64)
            ahead[: total - depth] = rank[depth:] + 1
            key = rank * (total + 1) + ahead
            order = np.argsort(key)
            sorted_key = key[order]
            change = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(total, dtype=np.int64)
            rank[order] = change
            depth *= 2
            if depth <= threshold:
                same.append((depth, rank.astype(np.int32)))
        # words that a row's place has in common with the one in front of it, up to the threshold or more
        common = np.zeros(total, dtype=np.int64)
        a, b = order[:-1], order[1:]
        for depth, number in reversed(same):
            at, to = a + common[1:], b + common[1:]
            inside = np.maximum(at, to) < total
            equal = np.zeros(len(a), dtype=bool)
            equal[inside] = number[at[inside]] == number[to[inside]]
            common[1:] += depth * equal
        self.threshold, self.total = threshold, total
        self.common = np.minimum(common, threshold).astype(np.uint8 if threshold < 256 else np.int32)
        new = self.common < threshold
        new[:1] = True
        self.group = np.cumsum(new) - 1  # by row
        starts = np.flatnonzero(new)
        self.least = np.minimum.reduceat(np.repeat(labels, lengths + 1)[order], starts) if total else labels[:0]
        # the rows around a row that have all but one word of the threshold in common with it
        near = self.common < threshold - 1
        near[:1] = True
        starts = np.flatnonzero(near)
        wide = np.cumsum(near) - 1
        self.wide_low, self.wide_high = starts[wide], np.append(starts[1:], total)[wide]
        self.mins: list[np.ndarray] = [np.append(self.common, 0)]  # least of 1, 2, 4, ... rows up to a row
        self.mins[0][:1] = 0
        while 1 << len(self.mins) <= total:
            last, span = self.mins[-1], 1 << (len(self.mins) - 1)
            wider = np.zeros_like(last)
            wider[span:] = np.minimum(last[span:], last[:-span])
            self.mins.append(wider)

        symbols = np.zeros(total, dtype=np.int64)  # 0: separator
        symbols[~separator] = words + 1
        self.transform = WaveletMatrix(symbols[order - 1], size + 1)
        counts = np.bincount(symbols, minlength=size + 1)
        self.smaller = np.cumsum(counts) - counts

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows [low, high) of a pattern, with ``word`` put in front."""
        first = self.smaller[word + 1]
        ranks = self.transform.rank(np.concatenate((word, word)) + 1, np.concatenate((low, high)))
        return first + ranks[: len(word)], first + ranks[len(word):]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, depth): the rows of the longest beginning of a pattern that more rows have."""
        depth = np.maximum(self.mins[0][low], self.mins[0][high]).astype(np.int64)
        for k in range(len(self.mins) - 1, -1, -1):
            span = 1 << k
            down = self.mins[k][low] >= depth  # the rows from low - span to low share so much
            low = np.where(down & (low >= span), low - span, low)
            up = np.minimum(high + span - 1, self.total)
            wide = (high + span <= self.total) & (self.mins[k][up] >= depth)
            high = np.where(wide, high + span, high)
        return low, high, depth

    def matches(self, words: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams passages that need not be in the index: (length, row) for each of their places in turn.

        ``length``: the matching statistic, how many words from the place on occur somewhere in the index
        as they are, up to the threshold. ``row``: a row of the index where they do. Matching goes back
        from a passage's last word, all passages in step; where a word cannot be put in front, the match
        is cut behind to the next length at which other rows come in.
        """
        first = np.cumsum(lengths) - lengths
        statistic = np.zeros(int(lengths.sum()), dtype=np.int64)
        row = np.zeros(int(lengths.sum()), dtype=np.int64)
        at = lengths - 1  # place that is to be matched next
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.total, dtype=np.int64)
        depth = np.zeros(len(at), dtype=np.int64)
        live = np.flatnonzero(at >= 0) if self.total else np.empty(0, np.int64)
        while len(live):
            full = live[depth[live] == self.threshold]
            low[full], high[full] = self.wide_low[low[full]], self.wide_high[low[full]]
            depth[full] = self.threshold - 1
            a, b = self.extend(words[start[live] + at[live]], low[live], high[live])
            found = a < b
            on = live[found]
            low[on], high[on], depth[on] = a[found], b[found], depth[on] + 1
            off = live[~found]
            none = off[depth[off] == 0]  # the word is not in the index
            cut = off[depth[off] > 0]
            low[cut], high[cut], depth[cut] = self.shorten(low[cut], high[cut])
            whole = cut[depth[cut] == 0]
            low[whole], high[whole] = 0, self.total
            done = np.concatenate((on, none))
            place = first[done] + at[done]
            statistic[place], row[place] = depth[done], low[done]
            at[done] -= 1
            live = live[at[live] >= 0]
        return statistic, row

    def owners(self, words: np.ndarray, start: np.ndarray, lengths: np.ndarray, none: int) -> np.ndarray:
        """The least label among the places where each window of ``threshold`` words of streamed passages
        occurs, ``none`` if it does not. Windows come passage by passage, in order."""
        statistic, row = self.matches(words, start, lengths)
        inside = np.arange(len(statistic)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        windows = inside <= np.repeat(lengths, lengths) - self.threshold
        statistic, row = statistic[windows], row[windows]
        out = np.full(len(row), none, dtype=np.int64)
        hit = statistic == self.threshold
        out[hit] = self.least[self.group[row[hit]]]
        return out
