"""Vectorised edit-similarity kernels that run inside Arrow batches.

The longest common subsequence is computed bit-parallel (Crochemore et al. 2001, Hyyro 2004):
one 64-bit word per 64 pattern characters, all pairs of a batch advancing together, one text
character per numpy step.

A block of titles searched by many proposals takes its own titles as the patterns: a step then reads one
row of match words for the proposal's character, in place of a word looked up for every pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_WORD = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.array([(1 << b) - 1 for b in range(_WORD + 1)], dtype=np.uint64)  # the lowest b bits
_MOST_WORDS = 1 << 23  # match words of a block; beyond them its titles are searched by bounds
_STEP = 1 << 12  # pairs that make a numpy step worth its call


def _code_matrix(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as an (n, longest) matrix, 0-padded, with the true lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    matrix = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return matrix, lengths


def _run(tables: np.ndarray, base: np.ndarray, columns: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Advance the bit-vector recurrence, one text character of all pairs per step.

    ``tables[w]`` holds match word w of every (pattern, symbol), ``base`` a pair's offset into it,
    ``columns[j]`` the j-th symbol of every pair, ``masks[w]`` the pattern bits that take part."""
    words, n = masks.shape
    state = np.full((words, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    slot, hit, total = np.empty(n, dtype=np.intp), np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    for column in columns:
        np.add(base, column, out=slot)
        carry = None
        for w in range(words):
            s = state[w]
            np.take(tables[w], slot, out=hit, mode="clip")
            hit &= masks[w]
            hit &= s
            np.add(s, hit, out=total)
            if words > 1:
                over = total < s
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            s -= hit
            s |= total
    return np.bitwise_count(~state & masks).sum(axis=0, dtype=np.int64)


def _advance(tables: np.ndarray, columns: np.ndarray, kept: np.ndarray, mask: bool, alive: list[dict]) -> np.ndarray:
    """The same recurrence with the rows of a block as patterns, (texts, rows) at a time: row ``columns[j, i]`` of a
    word's table stands for character j of text i in all patterns. ``kept`` holds the pattern bits that take part, by
    which the tables still are to be masked if ``mask``, ``alive[i][j]`` the patterns for which a character does."""
    (words, _, n), g = tables.shape, columns.shape[1]
    state = np.full((words, g, n), _ONES)
    hit, total = np.empty((g, n), dtype=np.uint64), np.empty((g, n), dtype=np.uint64)
    live = [j for j, c in enumerate(columns.tolist()) if any(c)]
    for j in live:
        masks = [(i, a[j]) for i, a in enumerate(alive) if j in a]
        carry = None
        for w in range(words):
            s = state[w]
            if g == 1:
                np.bitwise_and(tables[w, columns[j, 0]], s, out=hit)
            else:
                np.take(tables[w], columns[j], axis=0, out=hit, mode="clip")
                hit &= s
            if mask:
                hit &= kept[w]
            for i, m in masks:
                hit[i] &= m
            np.add(s, hit, out=total)
            if words > 1:
                over = total < s
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            s ^= hit
            s |= total
    np.invert(state, out=state)
    state &= kept
    return np.bitwise_count(state).sum(axis=0, dtype=np.int32)


def _advance_one(tables: np.ndarray, column: np.ndarray, alive: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The same for one text and its own ``tables`` (words, symbols, rows), whose place 0 stands for characters that no
    row has; those are passed over. Of a pattern's bits only those that a symbol's words hold take part, the others stay
    set. ``alive`` lists, by character, the last so many patterns and for which of them the character counts."""
    words, _, n = tables.shape
    state = np.full((words, n), _ONES)
    hit, total = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    masks = dict(alive)
    for j, symbol in enumerate(column.tolist()):
        if not symbol:
            continue
        mask, carry = masks.get(j), None
        for w in range(words):
            s = state[w]
            np.bitwise_and(tables[w, symbol], s, out=hit)
            if mask is not None:
                hit[n - len(mask):] &= mask
            np.add(s, hit, out=total)
            if words > 1:
                over = total < s
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            s ^= hit
            s |= total
    return words * _WORD - np.bitwise_count(state).sum(axis=0, dtype=np.int32)


def lcs_lengths(left: Sequence[str], right: Sequence[str], cells: int = 1 << 22) -> np.ndarray:
    """LCS length of each (left[i], right[i]); work is cut into slices of bounded memory."""
    n = len(left)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    sizes = np.fromiter((max(len(a), len(b)) for a, b in zip(left, right)), dtype=np.int64, count=n)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < n:
        stop = start + 1
        while stop < n and sizes[order[stop]] * (stop + 1 - start) <= cells:
            stop += 1
            if sizes[order[stop - 1]] > 2 * max(int(sizes[order[start]]), 32):
                break
        rows = order[start:stop]
        out[rows] = _lcs_slice([left[i] for i in rows], [right[i] for i in rows])
        start = stop
    return out


def _lcs_slice(left: list[str], right: list[str]) -> np.ndarray:
    patterns, which = np.unique(np.array(left, dtype=object), return_inverse=True)
    pat, pat_len = _code_matrix(list(patterns))
    txt, txt_len = _code_matrix(right)
    alphabet = np.unique(pat[pat > 0])
    symbols = np.searchsorted(alphabet, txt)
    symbols[symbols == len(alphabet)] = 0
    if len(alphabet):
        symbols = np.where(alphabet[symbols] == txt, symbols + 1, 0)
    words = max(1, -(-pat.shape[1] // _WORD))
    width = len(alphabet) + 1
    tables = np.zeros((words, len(patterns) * width), dtype=np.uint64)
    full = np.zeros((words, len(patterns)), dtype=np.uint64)
    rows, cols = np.nonzero(np.arange(pat.shape[1])[None, :] < pat_len[:, None])
    slot = rows * width + 1 + np.searchsorted(alphabet, pat[rows, cols])
    bit = np.uint64(1) << (cols % _WORD).astype(np.uint64)
    np.bitwise_or.at(tables, (cols // _WORD, slot), bit)
    np.bitwise_or.at(full, (cols // _WORD, rows), bit)
    return _run(tables, which * width, np.ascontiguousarray(symbols.T), full[:, which])


def token_set_scores(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Token-set similarity 0..100 of each pair of strings."""
    n = len(left)
    shared_len = np.zeros(n)
    only_l, only_r = [""] * n, [""] * n
    kind = np.zeros(n, dtype=np.int8)  # 0 = one side empty, 1 = one side contained, 2 = measure
    memo: dict[str, frozenset] = {}
    for i, (a, b) in enumerate(zip(left, right)):
        ta = memo.get(a)
        if ta is None:
            ta = memo[a] = frozenset(a.split())
        tb = memo.get(b)
        if tb is None:
            tb = memo[b] = frozenset(b.split())
        if not ta or not tb:
            continue
        both = ta & tb
        if both and (len(both) == len(ta) or len(both) == len(tb)):
            kind[i] = 1
            continue
        kind[i] = 2
        shared_len[i] = sum(map(len, both)) + max(len(both) - 1, 0)
        only_l[i] = " ".join(sorted(ta - both))
        only_r[i] = " ".join(sorted(tb - both))
    score = np.where(kind == 1, 100.0, 0.0)
    m = np.nonzero(kind == 2)[0]
    if len(m):
        xs, ys = [only_l[i] for i in m], [only_r[i] for i in m]
        score[m] = blend_token_set(
            shared_len[m],
            np.fromiter(map(len, xs), dtype=np.float64, count=len(xs)),
            np.fromiter(map(len, ys), dtype=np.float64, count=len(ys)),
            lcs_lengths(xs, ys),
        )
    return score


def blend_token_set(shared, len_l, len_r, common) -> np.ndarray:
    gap = (shared > 0).astype(np.float64)
    with_l, with_r = shared + gap + len_l, shared + gap + len_r
    rest = 100.0 - 100.0 * (len_l + len_r - 2.0 * common) / (with_l + with_r)
    return np.where(shared > 0, np.maximum(rest, overlap_bound(shared, len_l, len_r)), rest)


def overlap_bound(shared, len_l, len_r) -> np.ndarray:
    """The part of the token-set score that needs no LCS: shared tokens against either whole side."""
    gap = (shared > 0).astype(np.float64)
    left = 100.0 - 100.0 * (gap + len_l) / np.maximum(2.0 * shared + gap + len_l, 1.0)
    right = 100.0 - 100.0 * (gap + len_r) / np.maximum(2.0 * shared + gap + len_r, 1.0)
    return np.where(shared > 0, np.maximum(left, right), 0.0)


def token_sort_scores(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Indel similarity 0..100 of the two token-sorted strings."""
    a = [" ".join(sorted(t.split())) for t in left]
    b = [" ".join(sorted(t.split())) for t in right]
    return indel_scores(a, b)


def indel_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), dtype=np.float64, count=len(a))
    gap = total - 2.0 * lcs_lengths(a, b)
    return np.where(total > 0, (1.0 - gap / np.maximum(total, 1.0)) * 100.0, 100.0)


def length_bands(titles: Sequence[str], cells: int) -> list[np.ndarray]:
    """Row numbers in bands by length. The matrices of a band, as wide as its longest title and as wide as the
    alphabet, hold at most ``cells`` and four times as many cells, unless a single title has more. Titles of one
    word of bits and of two share no band with longer ones."""
    lengths = np.fromiter(map(len, titles), dtype=np.int64, count=len(titles))
    order = np.argsort(lengths, kind="stable")
    alphabet: set[str] = set()
    for t in titles:
        alphabet.update(t)
    most = max(4 * cells // (len(alphabet) + 1), 1)
    ends = np.searchsorted(lengths[order], [_WORD, 2 * _WORD], side="right")
    bands, start = [], 0
    while start < len(order):
        end = min((e for e in ends.tolist() if e > start), default=len(order))
        ahead = lengths[order[start:min(start + most, end)]]
        fits = np.arange(1, len(ahead) + 1) * ahead <= cells  # falls once: the longer, the fewer
        stop = start + max(int(fits.sum()), 1)
        bands.append(np.sort(order[start:stop]))
        start = stop
    return bands


class TitleBlock:
    """A bounded block of corpus titles prepared once and scored against many proposals."""

    def __init__(self, titles: Sequence[str], positions: np.ndarray):
        self.positions = np.asarray(positions)
        self.n = len(titles)
        sets = [sorted(set(t.split())) for t in titles]
        self.count = np.fromiter(map(len, sets), dtype=np.int64, count=self.n)
        self.chars = np.fromiter((sum(map(len, s)) for s in sets), dtype=np.int64, count=self.n)
        width = max(int(self.count.max(initial=0)), 1)
        # every token of every title in one row: its title, its number among the different tokens and its characters
        slots: dict[str, int] = {}
        number = np.fromiter((slots.setdefault(t, len(slots)) for s in sets for t in s), dtype=np.int64, count=int(self.count.sum()))
        of_title = np.repeat(np.arange(self.n), self.count)
        self.first = np.cumsum(self.count) - self.count  # place of a title's first token in that row
        ordinal = np.arange(len(number)) - self.first[of_title]
        sizes = np.fromiter((len(t) for t in slots), dtype=np.int64, count=len(slots))[number] + (ordinal > 0)
        self.slots, self.by_token = slots, np.argsort(number, kind="stable")
        self.title_by_token = of_title[self.by_token]
        self.stops = np.cumsum(np.bincount(number, minlength=len(slots))).tolist()
        # token ordinal of every character; a separator belongs to the token after it
        strings = [" ".join(s) for s in sets]
        codes, self.length = _code_matrix(strings)
        owner = np.full(codes.shape, width, dtype=np.int16 if width < 2**15 else np.int32)
        owner[np.arange(codes.shape[1]) < self.length[:, None]] = np.repeat(ordinal, sizes)
        self.width = width
        self.alphabet = np.unique(codes[codes > 0])
        self.codes = codes
        small = np.uint8 if len(self.alphabet) < 255 else np.uint32
        self.symbols = np.where(codes > 0, np.searchsorted(self.alphabet, codes) + 1, 0).astype(small)
        self.owner = owner
        rows, cols = np.nonzero(codes)
        size = len(self.alphabet) + 1
        bag = np.bincount(rows * size + self.symbols[rows, cols], minlength=self.n * size)
        count = np.uint16 if codes.shape[1] < 2**16 else np.uint32
        self.bag = np.ascontiguousarray(bag.reshape(self.n, size).T.astype(count))
        self.words = max(1, -(-codes.shape[1] // _WORD))
        self.live = self.count > 0
        self.space = int(np.searchsorted(self.alphabet, ord(" ")) + 1) if ord(" ") in self.alphabet else 0
        self.tables = None
        if self.words * self.n * size <= _MOST_WORDS:
            self._fill(rows, cols, size, sizes)

    def holders(self, token: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The titles that have a token, and its place there among all tokens."""
        slot = self.slots.get(token)
        if slot is None:
            return None
        span = slice(self.stops[slot - 1] if slot else 0, self.stops[slot])
        return self.title_by_token[span], self.by_token[span]

    def _fill(self, rows: np.ndarray, cols: np.ndarray, size: int, sizes: np.ndarray) -> None:
        """Match words of every (word, symbol, title), the bits of every title and of each of its tokens."""
        self.tables = np.zeros((self.words, size, self.n), dtype=np.uint64)
        np.bitwise_or.at(self.tables, (cols // _WORD, self.symbols[rows, cols], rows),
                         np.uint64(1) << (cols % _WORD).astype(np.uint64))
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], ends))[self.first]
        ends -= np.repeat(before, self.count)
        self.token_bits = [self._span(ends, w) & ~self._span(ends - sizes, w) for w in range(self.words)]
        self.full = np.stack([self._span(self.length, w) for w in range(self.words)])
        # a bit of ``levels`` for every number a letter comes to, set for the titles that reach it; numbers beyond what
        # all but a few titles have are left out, and granted to all of them instead
        self.levels = None
        if self.n < _STEP // 2:
            return
        self.tokens, self.extent = self.count.astype(np.float32), self.length.astype(np.float32)
        self.room = np.empty(0, dtype=np.uint64)  # match words of one title's rows, brought together
        for one_in in (400, 100):
            at = self.n - 1 - self.n // one_in
            self.most = np.partition(self.bag, at, axis=1)[:, at].astype(np.int64)
            self.most[[0, self.space]] = 0
            if int(self.most.sum()) * self.n <= _MOST_WORDS:
                self.level_symbol = np.repeat(np.arange(size), self.most)
                self.level = np.arange(len(self.level_symbol)) - np.repeat(np.cumsum(self.most) - self.most, self.most)
                self.levels = np.zeros((-(-len(self.level) // _WORD), self.n), dtype=np.uint64)
                for i, (symbol, level) in enumerate(zip(self.level_symbol.tolist(), self.level.tolist())):
                    self.levels[i // _WORD] |= (self.bag[symbol] > level).astype(np.uint64) << np.uint64(i % _WORD)
                self.asked = None
                return

    @staticmethod
    def _span(ends: np.ndarray, w: int) -> np.ndarray:
        """Word ``w`` of the bits before ``ends``."""
        return _LOW[np.clip(ends - w * _WORD, 0, _WORD)]

    def shared_letters(self, asked: _Asked) -> np.ndarray:
        """How many letters every row and the title have in common, whatever their order, separators apart."""
        counts = asked.letters(len(self.most))
        beyond = int(np.maximum(counts - self.most, 0)[1:].sum())
        reached = np.zeros(len(self.levels) * _WORD, dtype=np.uint8)
        reached[:len(self.level)] = self.level < counts[self.level_symbol]
        small = self.codes.shape[1] + beyond < 256  # what a row has, and what it is granted
        bag = np.full(self.n, beyond, dtype=np.uint8 if small else np.uint32)
        masked, some = np.empty(self.n, dtype=np.uint64), np.empty(self.n, dtype=np.uint8)
        for row, mask in zip(self.levels, np.packbits(reached, bitorder="little").view(np.uint64)):
            if mask:
                np.bitwise_count(np.bitwise_and(row, mask, out=masked), out=some)
                bag += some
        return bag

    def letters_needed(self, length: int, tokens: int, floor: float) -> np.ndarray:
        """How many letters a row must share with a title of so many characters and tokens to reach ``floor``. Titles come
        by length, so the last answer often serves again."""
        if self.asked != (length, tokens, floor):
            # single precision holds the counts; the slack absorbs its rounding
            need = (self.extent + np.float32(length)) * np.float32(floor / 200.0 - 1e-4)
            need -= np.minimum(self.tokens, np.float32(tokens)) - np.float32(1)
            np.ceil(need, out=need)
            small = self.codes.shape[1] + length < 256
            self.needed = np.maximum(need, 0).astype(np.uint8) if small else need
            self.asked = length, tokens, floor
        return self.needed

    def best(self, titles: Sequence[str], k: int, floor: float | np.ndarray, pairs: int = 1 << 14):
        """For each title the row numbers and scores of the k best rows scoring at least ``floor``, one for all or
        one for each (ties by position). A block whose match words fit measures all its rows. In another, rows are skipped
        only when a bound proves they cannot be among the best, and titles of similar length are taken together, as many
        as keep a numpy step near ``pairs`` pairs."""
        floors = np.broadcast_to(np.asarray(floor, dtype=np.float64), len(titles)).tolist()
        if self.tables is not None:
            return self._best_of_all(titles, k, floors)
        group = max(1, 2 * pairs // max(self.n, 1))
        results: list = [None] * len(titles)
        order = sorted(range(len(titles)), key=lambda i: len(titles[i]))
        for at in range(0, len(titles), group):
            open_ = [_Search(self, titles[i], k, floors[i]) for i in order[at:at + group]]
            size = 1024
            while True:
                live = [(s, s.take(size)) for s in open_ if len(s.todo)]
                if not live:
                    break
                common = self._common(live)
                start = 0
                for s, rows in live:
                    s.settle(rows, common[start:start + len(rows)])
                    start += len(rows)
                size *= 2
            for i, s in zip(order[at:at + group], open_):
                results[i] = s.result()
        return results

    def _best_of_all(self, titles: Sequence[str], k: int, floors: list[float]) -> list:
        results: list = [None] * len(titles)
        order = sorted(range(len(titles)), key=lambda i: len(titles[i]))
        if self.levels is not None:
            for i in order:
                a = _Asked(self, titles[i])
                a.meet()
                alone, met = a.within(self.shared_letters(a), floors[i])
                results[i] = a.result(alone, met, self._common_of(a, alone, met), k, floors[i])
            return results
        group = max(1, _STEP // max(self.words * self.n, 1))
        for at in range(0, len(titles), group):
            asked = [_Asked(self, titles[i]) for i in order[at:at + group]]
            for a in asked:
                a.meet()
            for i, a, common in zip(order[at:at + group], asked, self._all_common(asked)):
                alone, met = a.every()
                results[i] = a.result(alone, met, common[np.concatenate((alone, a.rows[met]))], k, floors[i])
        return results

    def _all_common(self, asked: list[_Asked]) -> np.ndarray:
        """LCS of the unshared remainders of every (asked title, row)."""
        columns = np.zeros((max(len(a.pattern) for a in asked), len(asked)), dtype=np.intp)
        for i, a in enumerate(asked):
            columns[:len(a.pattern), i] = a.symbols
        masked = any(a.found for a in asked)
        kept = np.repeat(self.full[:, None, :], len(asked) if masked else 1, axis=1)
        alive: list[dict] = [{} for _ in asked]
        for i, a in enumerate(asked):
            if a.found:
                kept[:, i, a.rows] = a.kept
            whole = {}
            for j, m in a.alive.items():
                if id(m) not in whole:
                    whole[id(m)] = np.full(self.n, _ONES)
                    whole[id(m)][a.rows] = m
                alive[i][j] = whole[id(m)]
        return _advance(self.tables, columns, kept, masked, alive)

    def _common_of(self, asked: _Asked, alone: np.ndarray, met: np.ndarray) -> np.ndarray:
        """The same of one title and some rows, first those that share no token with it, then the places ``met`` among
        those that do. Their match words are brought together once; only the latter's are masked."""
        rows = np.concatenate((alone, asked.rows[met]))
        if not len(rows):
            return np.zeros(0, dtype=np.int32)
        some, column = np.unique(np.append(asked.symbols, 0), return_inverse=True)
        cells = self.words * len(some) * len(rows)
        if len(self.room) < cells:
            self.room = np.empty(cells, dtype=np.uint64)
        tables = self.room[:cells].reshape(self.words, len(some), len(rows))
        for w in range(self.words):
            for j, symbol in enumerate(some[1:], start=1):
                np.take(self.tables[w, symbol], rows, out=tables[w, j], mode="clip")
        if len(met):
            tables[:, 1:, len(alone):] &= asked.kept[:, None, met]
        held = {id(m): m[met] for m in asked.alive.values()}
        return _advance_one(tables, column[:-1], [(j, held[id(m)]) for j, m in asked.alive.items()])

    def _common(self, live: list[tuple[_Search, np.ndarray]]) -> np.ndarray:
        """LCS of the unshared remainders, the shared tokens masked out of both sides."""
        words = max(-(-len(s.pattern) // _WORD) for s, _ in live)
        width = len(self.alphabet) + 1
        tables = np.zeros((words, len(live) * width), dtype=np.uint64)
        keep, text, base = [], [], []
        for g, (s, rows) in enumerate(live):
            s.fill_table(tables[:, g * width:(g + 1) * width])
            keep.append(s.kept_bits(rows, words))
            text.append(s.remaining_text(rows))
            base.append(np.full(len(rows), g * width, dtype=np.intp))
        steps = max(int(self.length[rows].max()) for _, rows in live)
        columns = np.ascontiguousarray(np.concatenate(text)[:, :steps].T)
        return _run(tables, np.concatenate(base), columns, np.concatenate(keep, axis=1))


class _Asked:
    """One title measured against the rows of a block. Of the rows that share tokens with it (``rows``): which of their
    bits and which of its own characters remain when those tokens are taken out."""

    def __init__(self, block: TitleBlock, title: str):
        self.block = block
        self.query = query = sorted(set(title.split()))
        self.pattern = " ".join(query)
        self.symbols = self._symbols()
        self.rows = np.empty(0, dtype=np.int64)
        self.alive: dict[int, np.ndarray] = {}  # for which of the rows a character remains, if not for all
        self.found = [(t, *found) for t, token in enumerate(query) if (found := block.holders(token)) is not None]

    def meet(self) -> None:
        """Fill in what the rows share with the title."""
        block, query = self.block, self.query
        if not self.found:
            return
        some = np.zeros(block.n, dtype=bool)
        for _, holders, _ in self.found:
            some[holders] = True
        self.rows = rows = np.nonzero(some)[0]
        place = np.empty(block.n, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        self.kept = block.full[:, rows]
        chars, common = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        unshared = {}
        for t, holders, at in self.found:
            own = place[holders]
            for w, bits in enumerate(block.token_bits):
                self.kept[w, own] &= ~bits[at]
            chars[own] += len(query[t])
            common[own] += 1
            unshared[t] = np.full(len(rows), _ONES)
            unshared[t][own] = 0
        self.chars = chars
        left_n, right_n = len(query) - common, block.count[rows] - common
        self.shared = chars + common - 1
        self.len_l = sum(map(len, query)) - chars + np.maximum(left_n - 1, 0)
        self.len_r = block.chars[rows] - chars + np.maximum(right_n - 1, 0)
        self.contained = (left_n == 0) | (right_n == 0)
        self.spaces = np.maximum(np.minimum(left_n, right_n) - 1, 0)
        # a row that lost its first token starts with a separator, which goes too
        cut = np.nonzero((self.kept[0] & np.uint64(1)) == 0)[0]
        for w in range(block.words):
            if not len(cut):
                break
            left = self.kept[w, cut]
            self.kept[w, cut] = left & (left - np.uint64(1))
            cut = cut[left == 0]
        at, before = 0, np.zeros(len(rows), dtype=np.uint64)  # rows that keep some token before this one; None: all
        for t, token in enumerate(query):
            own = unshared.get(t)
            if t:
                lead = own if before is None else before if own is None else before & own
                if lead is not None:
                    self.alive[at] = lead
                at += 1
            if own is not None:
                self.alive.update(dict.fromkeys(range(at, at + len(token)), own))
            at += len(token)
            before = None if own is None or before is None else before | own

    def letters(self, symbols: int) -> np.ndarray:
        """How often each block symbol is in the title, separators apart."""
        counts = np.bincount(self.symbols, minlength=symbols)
        counts[self.block.space] = 0
        return counts

    def _symbols(self) -> np.ndarray:
        """Block symbols of the characters, 0 for those no row has."""
        alphabet, text = self.block.alphabet, self.pattern
        points = np.array([text], dtype=f"U{max(len(text), 1)}").view(np.uint32)[:len(text)]
        if not len(alphabet):
            return np.zeros(len(points), dtype=np.intp)
        slot = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
        return np.where(alphabet[slot] == points, slot + 1, 0)

    def every(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows with words that share no token with the title, and the places of all that do."""
        alone = self.block.live.copy()
        alone[self.rows] = False
        return np.nonzero(alone)[0], np.arange(len(self.rows))

    def within(self, bag: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The same, of the rows that their letters, whatever the order, let reach ``floor``; none of a title without words."""
        block, query = self.block, self.query
        if not query:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        near = bag >= block.letters_needed(len(self.pattern), len(query), floor)
        near &= block.live
        near[self.rows] = False
        met = np.empty(0, dtype=np.int64)
        if self.found:
            met = np.nonzero(self._reach(bag[self.rows] - self.chars + self.spaces, floor - 0.02, slice(None)))[0]
        return np.nonzero(near)[0], met

    def result(self, alone: np.ndarray, met: np.ndarray, lcs: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows ``alone`` and those at the places ``met``, whose remainders have ``lcs`` in common."""
        block, query = self.block, self.query
        if not query:
            return np.empty(0, dtype=np.int64), np.empty(0)
        # the slack only absorbs rounding: the scores themselves decide below
        low, own, common = floor - 1e-6, len(self.pattern), lcs[len(alone):]
        near = np.nonzero(200.0 * lcs[:len(alone)] >= low * (block.length[alone] + own))[0]
        rows, lcs = alone[near], lcs[near]
        scores = blend_token_set(np.zeros(len(rows)), np.full(len(rows), float(own)), block.length[rows].astype(np.float64), lcs)
        if len(met):
            near = np.nonzero(self._reach(common, low, met))[0]
            met, common = met[near], common[near]
            lengths = [x[met].astype(np.float64) for x in (self.shared, self.len_l, self.len_r)]
            measured = np.where(self.contained[met], 100.0, blend_token_set(*lengths, common))
            rows, scores = np.concatenate((rows, self.rows[met])), np.concatenate((scores, measured))
        bar = floor
        if len(rows) > k:
            bar = max(floor, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        keep = np.nonzero(scores >= bar)[0]
        keep = keep[np.lexsort((block.positions[rows[keep]], -scores[keep]))[:k]]
        return rows[keep], scores[keep]

    def _reach(self, common: np.ndarray, low: float, met) -> np.ndarray:
        """Which of the rows at the places ``met`` score ``low``, if their remainders have ``common`` in common."""
        shared, len_l, len_r = self.shared[met], self.len_l[met], self.len_r[met]
        whole = len_l + len_r + 2 * shared + 2
        parts = 200.0 * shared >= low * (2 * shared + 1 + np.minimum(len_l, len_r))
        return self.contained[met] | parts | (200.0 * (common + shared + 1) >= low * whole)


class _Search:
    """One title being searched in a block: bounds, scores so far, rows still to measure."""

    def __init__(self, block: TitleBlock, title: str, k: int, floor: float):
        self.block, self.k, self.floor = block, k, floor
        self.query = query = sorted(set(title.split()))
        self.pattern = " ".join(query)
        self.todo = np.empty(0, dtype=np.int64)
        n = block.n
        self.bar = floor
        self.score = np.where(block.count > 0, 0.0, -1.0) if query else np.full(n, -1.0)
        if not query or not n:
            return
        self.shared = np.zeros(n)
        self.len_l = np.full(n, float(len(self.pattern)))
        self.len_r = block.length.astype(np.float64)
        bag = self._bag_overlap()
        gaps = np.minimum(len(query), block.count) - 1
        with np.errstate(invalid="ignore", divide="ignore"):
            self.upper = 200.0 * (bag + gaps) / (self.len_l + self.len_r)
        self._meet(bag)
        self._raise_bar()
        # the slack only absorbs rounding: a bound may keep a row too many, never one too few
        todo = np.nonzero((self.upper >= self.bar - 1e-6) & (block.count > 0))[0]
        self.todo = todo[np.argsort(-self.upper[todo], kind="stable")]

    def _meet(self, bag: np.ndarray) -> None:
        """Rows that share tokens: exact lengths, the score the shared part alone gives, its bound."""
        block, query = self.block, self.query
        found = [(t, *found) for t, token in enumerate(query) if (found := block.holders(token)) is not None]
        if not found:
            self.place = np.full(block.n, -1)
            return
        rows = np.unique(np.concatenate([w for _, w, _ in found]))
        self.place = np.full(block.n, -1)
        self.place[rows] = np.arange(len(rows))
        self.match = np.zeros((len(rows), len(query)), dtype=bool)
        self.dropped = np.zeros((len(rows), block.width + 1), dtype=bool)
        for t, where, token in found:
            at = self.place[where]
            self.match[at, t] = True
            self.dropped[at, token - block.first[where]] = True
        sizes = np.array([len(t) for t in query], dtype=np.int64)
        common = self.match.sum(axis=1)
        chars = self.match @ sizes
        left_n, right_n = len(query) - common, block.count[rows] - common
        self.shared[rows] = chars + common - 1
        self.len_l[rows] = sizes.sum() - chars + np.maximum(left_n - 1, 0)
        self.len_r[rows] = block.chars[rows] - chars + np.maximum(right_n - 1, 0)
        lengths = self.shared[rows], self.len_l[rows], self.len_r[rows]
        contained = (left_n == 0) | (right_n == 0)
        self.score[rows] = np.where(contained, 100.0, overlap_bound(*lengths))
        ceiling = bag[rows] - chars + np.maximum(np.minimum(left_n, right_n) - 1, 0)
        self.upper[rows] = np.where(contained, -1.0, blend_token_set(*lengths, ceiling))

    def take(self, size: int) -> np.ndarray:
        rows, self.todo = self.todo[:size], self.todo[size:]
        return rows

    def settle(self, rows: np.ndarray, common: np.ndarray) -> None:
        self.score[rows] = blend_token_set(self.shared[rows], self.len_l[rows], self.len_r[rows], common)
        self._raise_bar()
        self.todo = self.todo[: np.searchsorted(-self.upper[self.todo], 1e-6 - self.bar, side="right")]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        keep = np.nonzero(self.score >= self.bar)[0]
        order = np.lexsort((self.block.positions[keep], -self.score[keep]))[: self.k]
        keep = keep[order]
        return keep, self.score[keep]

    def _raise_bar(self) -> None:
        """A score that at least k rows already reach: nothing below it can be among the k best."""
        n = len(self.score)
        if n > self.k:
            self.bar = max(self.floor, float(np.partition(self.score, n - self.k)[n - self.k]))

    def _bag_overlap(self) -> np.ndarray:
        """Characters both token sets hold regardless of order, separators apart."""
        block = self.block
        points, counts = np.unique(np.array([ord(c) for c in "".join(self.query)], dtype=np.uint32),
                                   return_counts=True)
        slot = np.searchsorted(block.alphabet, points)
        known = slot < len(block.alphabet)
        known[known] = block.alphabet[slot[known]] == points[known]
        caps = np.minimum(counts[known], 65535).astype(np.uint16)
        return np.minimum(block.bag[slot[known] + 1], caps[:, None]).sum(axis=0, dtype=np.int64)

    def fill_table(self, table: np.ndarray) -> None:
        """Bit positions of every block character in the pattern."""
        alphabet = self.block.alphabet
        points = np.array([self.pattern], dtype=f"U{len(self.pattern)}").view(np.uint32)
        symbol = np.searchsorted(alphabet, points)
        known = symbol < len(alphabet)
        known[known] = alphabet[symbol[known]] == points[known]
        at = np.nonzero(known)[0]
        np.bitwise_or.at(table, (at // _WORD, symbol[at] + 1), np.uint64(1) << (at % _WORD).astype(np.uint64))

    def kept_bits(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Pattern bits per row: the characters of unshared tokens, without a leading separator."""
        query, place = self.query, self.place[rows]
        bits = np.zeros((1, words * _WORD), dtype=np.uint8)
        bits[:, :len(self.pattern)] = 1
        whole = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        out = np.repeat(whole.T, len(rows), axis=1)
        some = np.nonzero(place >= 0)[0]
        if not len(some):
            return out
        match = self.match[place[some]]
        if len(query) < 63:
            code = match @ (1 << np.arange(len(query), dtype=np.int64))
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            kinds = match[first]
        else:
            kinds, inverse = np.unique(match, axis=0, return_inverse=True)
        owner = np.repeat(np.arange(len(query)), [len(t) + (i > 0) for i, t in enumerate(query)])
        alive = ~kinds[:, owner]
        lead = np.concatenate(([0], np.cumsum([len(t) for t in query])[:-1] + np.arange(len(query) - 1)))
        start = np.argmin(kinds, axis=1)
        late = np.nonzero(start > 0)[0]
        alive[late, lead[start[late]]] = False
        bits = np.zeros((len(kinds), words * _WORD), dtype=np.uint8)
        bits[:, :alive.shape[1]] = alive
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        out[:, some] = packed[inverse.ravel()].T
        return out

    def remaining_text(self, rows: np.ndarray) -> np.ndarray:
        """Block symbols with shared tokens (and then a leading separator) blanked out."""
        text = self.block.symbols[rows]
        place = self.place[rows]
        some = np.nonzero(place >= 0)[0]
        if len(some):
            gone = self.dropped[place[some]]
            own = self.block.owner[rows[some]]
            off = np.take_along_axis(gone, own.astype(np.int64), axis=1)
            first = np.argmin(gone, axis=1)
            lead = (own == first[:, None]) & (first > 0)[:, None]
            at = np.argmax(lead, axis=1)
            hit = lead[np.arange(len(some)), at]
            off[np.nonzero(hit)[0], at[hit]] = True
            part = text[some]
            part[off] = 0
            text[some] = part
        return text
