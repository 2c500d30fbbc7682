"""Suffix arrays by induced sorting, and permuted common prefixes (numpy; one bounded shard at a time).

Suffixes are smaller (S) or larger (L) than their right neighbour; a leftmost
smaller one (LMS) follows a larger. Sorting the substrings between LMS places
by induction names them; the names form a string of half the length at most.
Unless all names differ, its suffixes are sorted too: by pairs of ranks of
doubling reach, only where they are not yet told apart (recursively where three
numbers of a place do not fit 63 bits). Their order induces the order of all
suffixes in two linear scans. A scan goes in stretches that do not depend on
themselves, each a few array operations.
"""

from __future__ import annotations

import numpy as np

# Places induced in one step, to begin with; shorter steps than the second are followed by single ones.
_STRETCH = 512
_SHORT = 16
# Two ranks and a place are sorted as one number.
_RANK_BITS = 21


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (whole numbers from 0) in order."""
    if not len(symbols):
        return np.empty(0, np.int64)
    # an end smaller than all symbols
    size = int(symbols.max()) + 2
    text = np.zeros(len(symbols) + 1, _symbol_type(size))
    np.add(symbols, 1, out=text[:-1], casting="unsafe")
    return _sort(text, size)[1:]


def _symbol_type(size: int) -> np.dtype:
    """The narrowest type that holds ``size``: symbols lie below it, and it stands for none."""
    return np.dtype(np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.int32 if size < 1 << 31 else np.int64)


def _by_symbol(symbol: np.ndarray) -> np.ndarray:
    """Places of the symbols in order, equal ones as they come."""
    if symbol.itemsize <= 2:  # these are sorted by radix
        return np.argsort(symbol, kind="stable")
    bits = len(symbol).bit_length()
    if symbol.itemsize > 4 or bits > 31:
        return np.argsort(symbol, kind="stable")
    keyed = (symbol.astype(np.int64) << bits) | np.arange(len(symbol))
    keyed.sort()
    return keyed & ((1 << bits) - 1)


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour (the last counts as smaller)."""
    # equal neighbours take the type of the next unequal pair
    at = np.flatnonzero(text[1:] != text[:-1])
    grows = np.append(text[at] < text[at + 1], True)
    return np.repeat(grows, np.diff(np.concatenate([[-1], at, [len(text) - 1]])))


def _sort(text: np.ndarray, size: int) -> np.ndarray:
    n = len(text)
    smaller = smaller_types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _Induction(text, smaller, size)
    order = induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names, distinct = _names(text, lms, order)
    if distinct < len(lms):
        by_name = _sort_names(names) if len(lms).bit_length() <= _RANK_BITS else _sort(names, distinct)
    else:
        by_name = np.empty(len(lms), np.int32)
        by_name[names] = np.arange(len(lms), dtype=np.int32)
    return induce(lms[by_name])


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal ones alike, and how many there are."""
    place = np.empty(len(text), np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    # from one LMS place to the next, both included; the last is the end alone
    length = np.append(np.diff(lms) + 1, 1)
    at = place[order]
    same = length[at[1:]] == length[at[:-1]]
    a, b, left = order[1:], order[:-1], length[at[1:]]
    todo, offset = np.flatnonzero(same), 0
    while len(todo):
        equal = text[a[todo] + offset] == text[b[todo] + offset]
        same[todo[~equal]] = False
        offset += 1
        todo = todo[equal]
        todo = todo[left[todo] > offset]
    rank = np.append(0, np.cumsum(~same))
    distinct = int(rank[-1]) + 1
    names = np.empty(len(lms), _symbol_type(distinct))
    names[at] = rank
    return names, distinct


def _sort_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order, by doubling: the last name is the smallest and occurs once."""
    n, bits = len(names), len(names).bit_length()
    low = (1 << bits) - 1
    rank = np.append(names.astype(np.int64) + 1, 0)
    order = rank[:n] << bits | np.arange(n)
    order.sort()
    order &= low
    # rank: how many suffixes are smaller by what is known, plus one; only suffixes that share theirs are open
    first = np.flatnonzero(np.append(True, rank[order[1:]] != rank[order[:-1]]))
    many = np.diff(np.append(first, n))
    rank[order] = np.repeat(first + 1, many)
    open_ = order[np.repeat(many > 1, many)]
    reach = 1
    while len(open_):
        own = rank[open_]
        keyed = (own << bits | rank[np.minimum(open_ + reach, n)]) << bits | open_
        keyed.sort()
        pairs, open_ = keyed >> bits, keyed & low
        own = pairs >> bits
        place = np.arange(len(open_))
        new_group = np.append(True, own[1:] != own[:-1])
        new = np.append(True, pairs[1:] != pairs[:-1])
        # where a suffix stands in its old group tells how much its rank grows
        group = np.maximum.accumulate(np.where(new_group, place, 0))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(open_)))
        rank[open_] = own + np.repeat(first, many) - group
        order[own - 1 + place - group] = open_
        open_ = open_[np.repeat(many > 1, many)]
        reach *= 2
    return order


class _Induction:
    """Orders all suffixes from LMS places in (some) order."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, size: int) -> None:
        self.text, self.smaller, self.size = text, smaller, size
        counts = np.bincount(text, minlength=size)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.larger_before, self.smaller_before = self._before(~smaller), self._before(smaller)

    def _before(self, wanted: np.ndarray) -> np.ndarray:
        """For each place the symbol before it, ``size`` if that place is not wanted; the last entry is for no place."""
        out = np.full(len(self.text) + 1, self.size, _symbol_type(self.size))
        np.copyto(out[1:-1], self.text[:-1], where=wanted[:-1], casting="unsafe")
        return out

    def __call__(self, lms: np.ndarray) -> np.ndarray:
        n = len(self.text)
        array = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
        symbol = self.text[lms]
        by = _by_symbol(symbol)
        counts = np.bincount(symbol, minlength=self.size)
        first = np.cumsum(counts) - counts
        symbol = symbol[by]
        # the last places of their buckets, in order
        array[self.end[symbol] - counts[symbol] + np.arange(len(lms)) - first[symbol]] = lms[by]
        self._scan(array, self.start.copy(), self.larger_before)
        array[(array >= 0) & self.smaller[array]] = -1
        array[0] = n - 1
        # the same from the right: smaller suffixes fill their buckets from the end
        self._scan(array[::-1], n - self.end, self.smaller_before)
        return array

    def _scan(self, array: np.ndarray, free: np.ndarray, symbol_before: np.ndarray) -> None:
        """Go through ``array``; each suffix puts the wanted one before it on its bucket's next free place.

        Stretches are done in one step each. What a stretch induces always
        lies further on; a stretch ends before the first place it fills.
        """
        at, size, n = 0, _STRETCH, len(array)
        while at < n:
            stop = min(at + size, n)
            found = symbol_before[array[at:stop]]
            source = np.flatnonzero(found != self.size)
            if len(source):
                symbol = found[source]
                low = int(free[symbol].min()) if len(source) < self.size else int(
                    free[np.flatnonzero(np.bincount(symbol, minlength=self.size))].min())
                if low < stop:
                    # every symbol's first place is free, so none lies before the lowest
                    stop = max(low, at + 1)
                    source = source[:np.searchsorted(source, stop - at)]
                    symbol = symbol[:len(source)]
            if len(source):
                by = _by_symbol(symbol)
                symbol = symbol[by]
                first = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
                first = np.concatenate([[0], first, [len(by)]])
                many, kinds = np.diff(first), symbol[first[:-1]]
                target = np.arange(len(by)) + np.repeat(free[kinds] - first[:-1], many)
                array[target] = array[at + source[by]] - 1
                free[kinds] += many
            if stop - at < _SHORT:
                at = self._step(array, free, symbol_before, stop)
            else:
                size = min(max(_STRETCH, 2 * (stop - at)), 1 << 16)
                at = stop

    def _step(self, array: np.ndarray, free: np.ndarray, symbol_before: np.ndarray, at: int) -> int:
        """A stretch place by place, for runs that fill the very next places."""
        stop = min(at + _STRETCH, len(array))
        for i in range(at, stop):
            j = int(array[i])
            c = int(symbol_before[j])
            if c != self.size:
                array[free[c]] = j - 1
                free[c] += 1
        return stop


def permuted_common_prefixes(data: bytes, array: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``data``: how long its suffix and the one before it in ``array`` agree, in text order.

    Exact up to ``most`` at the places of ``begins`` (segment starts, the
    first included) and for places less than ``most`` behind one. Where the
    symbols before a place and before its neighbour are equal, the place
    agrees for one symbol less than its predecessor; only the others are
    compared.
    """
    n = len(array)
    near = np.empty(n, np.int64)
    near[array[0]] = -1
    near[array[1:]] = array[:-1]
    symbols = np.frombuffer(data, np.uint8)
    fresh = near <= 0
    fresh[1:] |= symbols[:-1] != symbols[near[1:] - 1]
    fresh[begins] = True
    padded = data + bytes(most + 16)
    words = np.empty(n + most + 8, np.uint64)
    for i in range(8):
        part = np.frombuffer(padded, "<u8", (len(words) - i + 7) // 8, i)
        words[i::8] = part
    at = np.flatnonzero(fresh)
    length = np.zeros(len(at), np.int64)
    todo = np.flatnonzero(near[at] >= 0)
    while len(todo):
        a, b = at[todo] + length[todo], near[at[todo]] + length[todo]
        inside = (a < n) & (b < n) & (length[todo] < most)
        todo, a, b = todo[inside], a[inside], b[inside]
        unlike = words[a] ^ words[b]
        equal = unlike == 0
        # whole bytes below the lowest differing bit
        low = unlike & (~unlike + np.uint64(1))
        bits = np.where(equal, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64))
        length[todo] += bits >> 3
        todo = todo[equal]
    reach = np.minimum(n - at, np.where(near[at] >= 0, n - near[at], 0))
    length = np.minimum(length, reach)
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[at] = length
    return np.maximum(value[source] - (np.arange(n) - source), 0)
