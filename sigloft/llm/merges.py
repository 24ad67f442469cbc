"""Byte-pair encoding read as a path problem.

A segmentation of a word is the one that the merges make if, and only if, each token is what its own text encodes to and each two
neighbours stay apart when their joint text is encoded. Each prefix of a word has exactly one such segmentation, so a table over
prefixes holds the last token of each, found from the shorter ones: the encoding, and the exact number of tokens, of every prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Bounds of the tables that remember words, and pairs and steps; they are emptied when full.
REMEMBERED, PAIRS = 1_000_000, 1_600_000


class Remembered(dict):
    """Answers by key, worked out once; bounded. Keys longer than ``longest`` are not kept."""

    def __init__(self, work, most: int = REMEMBERED, longest: int | None = None):
        super().__init__()
        self.work, self.most, self.longest = work, most, longest

    def __missing__(self, key):
        value = self.work(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value

    def prepare(self, keys: set) -> None:
        """Works out the new ones of many keys in order, so that neighbours share what they begin with."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(keys)
        for k in sorted(new):
            if len(k) <= self.longest:
                self[k] = self.work(k)


class PairEncoding:
    """Tokens over strings or bytes.

    ``symbols``: the single symbols, which are tokens without a merge. ``rank``: the priority of each token that a merge makes, lowest
    first. ``merges``: which two tokens may merge; None if any two may whose joint text is a token.
    """

    def __init__(self, symbols: list, rank: dict, merges: set | None = None):
        self.rank, self.merges = rank, merges
        self.texts = [*symbols, *rank]
        self.first_merged = len(symbols)
        self._automaton()
        self.last_merge = Remembered(self._last_merge)
        self.made = Remembered(lambda token: self.last_merge[self.texts[token]] is not None)
        self.apart = Remembered(self._apart, PAIRS)
        self.following = Remembered(self._following, PAIRS)
        self.word, self.states, self.last, self.counts = self.texts[0][:0], [0], [-1], [0]

    def _automaton(self) -> None:
        """States are the beginnings of tokens; each knows the tokens that end there, the shortest first, as (number, size)."""
        self.next: list[dict[int, int]] = [{}]
        self.ending: list[tuple] = [()]
        for number, text in enumerate(self.texts):
            state = 0
            for symbol in map(ord, text) if isinstance(text, str) else text:
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.ending.append(())
                state = self.next[state][symbol]
            self.ending[state] = ((number, len(text)),)
        self.back, level = [0] * len(self.next), list(self.next[0].values())
        while level:
            deeper = []
            for state in level:
                self.ending[state] = self.ending[self.back[state]] + self.ending[state]
                for symbol, child in self.next[state].items():
                    back = self.back[state]
                    while back and symbol not in self.next[back]:
                        back = self.back[back]
                    self.back[child] = self.next[back].get(symbol, 0)
                    deeper.append(child)
            level = deeper

    def _following(self, key: int) -> int:
        state, symbol = key >> 21, key & 0x1FFFFF
        while state and symbol not in self.next[state]:
            state = self.back[state]
        return self.next[state].get(symbol, 0)

    def joined(self, left, right) -> int | None:
        """The priority of merging two neighbours; None if they don't merge."""
        if self.merges is not None and (left, right) not in self.merges:
            return None
        return self.rank.get(left + right)

    def merge(self, text) -> tuple[list, tuple | None]:
        """The tokens of a short text by merging, always the best pair, the leftmost of equals; and the last pair merged."""
        parts, last = [text[i : i + 1] for i in range(len(text))], None
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.joined(parts[i], parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _last_merge(self, token) -> tuple | None:
        """The two tokens whose merge makes this one; () for a symbol, None if merging never makes it."""
        if len(token) == 1:
            return ()
        parts, last = self.merge(token)
        return last if len(parts) == 1 else None

    def _apart(self, pair: int) -> bool:
        """True if two tokens stay apart: going back in time, no merge across their border was due before theirs."""
        left, right = (self.texts[i] for i in divmod(pair, len(self.texts)))
        rank, last_merge = self.rank, self.last_merge
        if last_merge[left] is None or last_merge[right] is None:
            return False
        if rank.get(left, -1) == rank.get(right, -2):  # equal priorities are settled by place
            return self.merge(left + right)[0] == [left, right]
        due = None
        while True:
            across = self.joined(left, right)
            if across is not None and (due is None or across < due):
                return False
            a, b = (rank[left] if len(left) > 1 else -1), (rank[right] if len(right) > 1 else -1)
            if a < 0 and b < 0:
                return True
            # The later of the two merges is undone first; at equal priority the left one was made first.
            if a > b:
                due, left = a, last_merge[left][1]
            else:
                due, right = b + 1, last_merge[right][0]

    def prefixes(self, word: Sequence) -> tuple[list[int], list[int]]:
        """For each prefix of a word, from the empty one on, the number of its last token (-1: none) and how many tokens it has.

        The table of the word before is kept as far as both begin alike; the lists are good until the next call.
        """
        before, same, size = self.word, 0, len(self.texts)
        for x, y in zip(before, word):
            if x != y:
                break
            same += 1
        states, last, counts = self.states, self.last, self.counts
        del states[same + 1 :], last[same + 1 :], counts[same + 1 :]
        self.word = word[:same]
        rest, state = word[same:], states[-1]
        apart, following, ending = self.apart, self.following, self.ending
        for j, symbol in enumerate(map(ord, rest) if isinstance(word, str) else rest, same + 1):
            state = following[state << 21 | symbol]
            for token, length in ending[state]:
                i = j - length
                if apart[last[i] * size + token] if i else self.made[token]:
                    states.append(state)
                    last.append(token)
                    counts.append(counts[i] + 1)
                    break
            else:
                self.word = word[: j - 1]
                raise ValueError("a prefix has no segmentation")
        self.word = word
        return last, counts

    def tokens(self, word: Sequence) -> list[int]:
        last, out, j = self.prefixes(word)[0], [], len(word)
        while j:
            out.append(last[j])
            j -= len(self.texts[last[j]])
        return out[::-1]
