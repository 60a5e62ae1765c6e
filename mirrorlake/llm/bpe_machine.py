"""A byte-pair encoding as a deterministic finite-state transducer, its states built when first reached.

Facts used.  A sequence of tokens is the encoding of its text exactly if every two neighbours are the
encoding of their joined text; and a prefix of an encoding is the encoding of the prefix it spells.  So
the last token at a position is the one token ``t`` ending there that forms a valid pair with the last
token at the position where ``t`` begins.  Only positions from which some token could still be under way
matter, so a state is the list, for each such position, of: the vocabulary-trie node of what has been
read since, the last token there, and the token count there relative to the count here.  A transition on
a symbol gives the next state, the change in the count of tokens, and the token that now ends the
encoding.
"""

from __future__ import annotations

from .common import worker_cache
from .tokenizer_files import byte_alphabet, read_vocabulary

NONE = -1


class BpeMachine:
    """Symbols are numbered from 0 to ``n_symbols``-1; ``base[s]`` is the token of symbol ``s`` alone."""

    def __init__(self, spelled: dict[int, tuple[int, ...]], base: list[int], merges: dict[tuple[int, int], tuple[int, int]], keep: int = 400_000):
        self.base, self.merges, self.keep = base, merges, keep
        self.spelled = spelled
        self.width = len(base)
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [NONE]
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                key = node * self.width + s
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(NONE)
                node = nxt
            self.token_at[node] = token
        self.inner = {k // self.width for k in self.child}  # nodes that have children
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, token) in merges.items():
            if token not in self.made_by or rank < self.made_by[token][0]:
                self.made_by[token] = (rank, left, right)
        self.spines: tuple[dict, dict] = ({}, {})
        self.is_whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, NONE, 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int, int]] = {}

    def encode_plainly(self, symbols) -> list[int]:
        """Merge by lowest rank, leftmost first: the definition, used on pairs of tokens only."""
        ids = [self.base[s] for s in symbols]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined text is encoded.

        Each token grows by its own merges until one across the border comes first.  The symbols that
        stand at the border meanwhile are the left token's rightmost parts and the right token's leftmost
        parts, each until the rank at which it is merged into the next.  Of equal ranks the left one goes
        first.
        """
        if left == NONE:
            return self.whole(right)
        merges = self.merges
        for x, x_until in self.border(left, 1):
            for y, y_until in self.border(right, 0):
                m = merges.get((x, y))
                if m is not None and m[0] < x_until and m[0] <= y_until:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        known = self.is_whole.get(token)
        if known is None:
            known = self.is_whole[token] = self.encode_plainly(self.spelled[token]) == [token]
        return known

    def border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that stand at its right (1) or left (0) end, with the rank that ends each."""
        spine = self.spines[side].get(token)
        if spine is None:
            spine, part, until = [], token, float("inf")
            while True:
                spine.append((part, until))
                made = self.made_by.get(part)
                if made is None:
                    break
                until, part = made[0], made[1 + side]
            self.spines[side][token] = spine
        return spine

    def step(self, state: int, symbol: int) -> tuple[int, int, int]:
        """Build the transition: next state, change of the count, last token."""
        last, change, under_way = NONE, 0, []
        child, token_at, inner, width = self.child, self.token_at, self.inner, self.width
        for node, before, count in self.states[state]:
            nxt = child.get(node * width + symbol)
            if nxt is None:
                continue
            token = token_at[nxt]
            if token != NONE and last == NONE and self.whole(token) and self.fits(before, token):
                last, change = token, count + 1
            if nxt in inner:
                under_way.append((nxt, before, count))
        new = (*((n, b, c - change) for n, b, c in under_way), (0, last, 0))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        made = self.table[state * self.width + symbol] = (to, change, last)
        return made

    def count(self, symbols) -> int:
        if len(self.table) > self.keep:
            self.reset()
        table, width, state, total = self.table, self.width, 0, 0
        for i, s in enumerate(symbols):
            hit = table.get(state * width + s) or self.step(state, s)
            state = hit[0]
            total += hit[1]
            if i & 0xFFFFF == 0xFFFFF and len(table) > self.keep:  # a very long run: drop all states but this one
                now = self.states[state]
                self.reset()
                table = self.table
                state = self.ids.setdefault(now, len(self.states))
                self.states.append(now)
        return total

    def encode(self, symbols) -> list[int]:
        if len(self.table) > self.keep:
            self.reset()
        table, width, state, last = self.table, self.width, 0, []
        for s in symbols:
            hit = table.get(state * width + s) or self.step(state, s)
            state = hit[0]
            last.append(hit[2])
        out, at, spelled = [], len(last), self.spelled
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(spelled[token])
        return out[::-1]


@worker_cache("token-counts")
def byte_level_machine(path: str) -> BpeMachine:
    """For a byte-level vocabulary: the symbols are the 256 bytes."""
    model = read_vocabulary(path)["model"]
    back = {c: b for b, c in byte_alphabet().items()}
    vocab = model["vocab"]
    spelled = {i: tuple(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
    base = [vocab[c] for _, c in sorted(byte_alphabet().items())]
    return BpeMachine(spelled, base, _merges(model))


@worker_cache("word-bpe")
def word_end_machine(path: str) -> BpeMachine:
    """For a vocabulary with word ends: 256 bytes, then the 256 bytes that end a word."""
    model = read_vocabulary(path)["model"]
    back = {c: b for b, c in byte_alphabet().items()}
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    spelled = {}
    for t, i in vocab.items():
        body = t.removesuffix(end)
        if not body or any(c not in back for c in body):
            continue
        symbols = [back[c] for c in body]
        if t != body:
            symbols[-1] += 256
        spelled[i] = tuple(symbols)
    letters = [c for _, c in sorted(byte_alphabet().items())]
    return BpeMachine(spelled, [vocab[c] for c in letters] + [vocab[c + end] for c in letters], _merges(model))


def _merges(model: dict) -> dict[tuple[int, int], tuple[int, int]]:
    vocab, out = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        out[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return out
