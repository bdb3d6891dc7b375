"""Token ids of whole texts, word by word, with a bounded memory of words per worker process.

Corpora repeat words, and both tokenizers used here never build a token across the gap between two words, so a word is
encoded once by the tokenizers library and its result is kept. The memory has two generations of bounded size; when the
younger one is full, the older one is dropped, so that frequent words stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

#: Words kept per generation; about 100 MB at the most.
WORDS = 400_000
#: Longer words (and texts without blanks) are not kept.
LONGEST = 64
#: An ASCII capital before a character that may combine with it: then lower-casing first could change the ids.
_CAPITAL_BEFORE_MARK = re.compile("[A-Z][\u0300-\U0010ffff]")
_SHARED: dict[tuple[type, str], object] = {}


def _is_plain(byte: int) -> bool:
    """An ASCII letter or digit."""
    return 97 <= byte <= 122 or 48 <= byte <= 57 or 65 <= byte <= 90


class _Remembered:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []

    @classmethod
    def shared(cls, path: str):
        """One instance per worker process."""
        if (cls, path) not in _SHARED:
            _SHARED[cls, path] = cls(path)
        return _SHARED[cls, path]

    def _make_room(self) -> None:
        for k in self.passing:
            del self.young[k]
        self.passing = []
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}

    def _learn(self, keys: Iterable, encode) -> None:
        """Have all ``keys`` in the younger generation; ``encode`` gets the list of those never seen."""
        young, old = self.young, self.old
        new = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        if new:
            young.update(zip(new, encode(new)))
            self.passing = [k for k in new if len(k) > LONGEST]


class WordMerges:
    """Ids of many short plain words at once: the tokenizer's own merges, applied to all words side by side.

    A row of a matrix is a word; a step merges in every row the pair that the tokenizer would merge next (the lowest rank,
    the leftmost of equal ones), until no row has a known pair.
    """

    #: Lower-case letters a-z and of Latin-1, composed: one run of letters that no rule before the merges changes.
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){2,24}")
    ROWS = 8_192

    def __init__(self, tokenizer):
        import numpy as np

        model = json.loads(tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.none = np.int32(len(merges))
        # the byte alphabet of such tokenizers: visible characters stand for themselves, the rest for 256 and on
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in seen)}
        self.inner = np.array([vocab.get(chr(rest.get(b, b)), 0) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(chr(rest.get(b, b)) + end, 0) for b in range(256)], np.int32)

    def _ranks(self, left, right):
        import numpy as np

        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], self.none)

    def ids(self, words: list[bytes]) -> list[bytes]:
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = [b""] * len(words)
        for lo in range(0, len(words), self.ROWS):
            part = by_size[lo : lo + self.ROWS]
            for i, got in zip(part, self._block([words[i] for i in part])):
                out[i] = got
        return out

    def _block(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        size = np.array([len(w) for w in words])
        column = np.arange(int(size.max()) + 1)
        data = np.frombuffer(b"".join(words), np.uint8)
        place = (np.cumsum(size) - size)[:, None] + column
        letter = data[np.minimum(place, len(data) - 1)]
        token = np.where(column < size[:, None] - 1, self.inner[letter], self.last[letter])
        token[column >= size[:, None]] = -1
        rank = np.full((len(words), len(column) - 1), self.none)
        pair = column[1:] < size[:, None]
        rank[pair] = self._ranks(token[:, :-1][pair], token[:, 1:][pair])
        rows = np.arange(len(words))
        done = token.copy()
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best < self.none
            done[rows[~live]] = token[~live]
            rows, at, best, token, rank = rows[live], at[live], best[live], token[live], rank[live]
            if not len(rows):
                break
            n, here = np.arange(len(rows)), at[:, None]
            token[:, :-1] = np.where(column[:-1] > here, token[:, 1:], token[:, :-1])
            token[:, -1] = -1
            token[n, at] = self.into[best]
            rank[:, :-1] = np.where(column[:-2] > here, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.none
            rank[n, at] = self._ranks(token[n, at], token[n, at + 1])
            before = at > 0
            rank[n[before], at[before] - 1] = self._ranks(token[n[before], at[before] - 1], token[n[before], at[before]])
        held = done >= 0
        blob = done[held].astype("<u4").tobytes()
        ends = (4 * np.cumsum(held.sum(1))).tolist()
        return [blob[lo:hi] for lo, hi in zip([0, *ends], ends)]


class WordIds(_Remembered):
    """Ids of a lower-casing word tokenizer that drops white space, as little-endian unsigned 32-bit numbers.

    Texts are split at ASCII blanks and line ends. The word "(Thor)," is looked up as "(", "thor" and "),": its tokenizer
    lower-cases and never joins an ASCII letter and a sign. Capitals are kept where lower-casing first might differ
    (a combining mark behind a capital, or the brackets of a special token), so that ids equal those of whole texts.
    """

    _MARK = "<|endoftext|>"
    _SIGNS = rb"[!-&(-/:-@\[-`{-~]"
    _EDGES = re.compile(rb"(%s*)(.*?)(%s*)" % (_SIGNS, _SIGNS), re.DOTALL)
    _HAS_EDGE = re.compile(rb"\A%s|%s\Z" % (_SIGNS, _SIGNS))

    def __init__(self, path: str):
        super().__init__(path)
        self.young.update({b"": b""})
        self.merges = WordMerges(self.tokenizer)
        self.mark = self.tokenizer.token_to_id(self._MARK)
        if self.mark is None:
            raise ValueError(f"the tokenizer has no {self._MARK}")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self._make_room()
        split = []
        for t in texts:
            t = t or ""
            b = t.encode("utf-8", "replace")
            if b"<|" not in b and (t.isascii() or not _CAPITAL_BEFORE_MARK.search(t)):
                b = b.lower()
            split.append(b.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" "))
        self._learn(set().union(*split), self._encode_words)
        find = self.young.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """ASCII signs at both ends of a word are looked up by themselves.

        The tokenizer splits a word into runs of letters, single digits, runs of other signs, and a few endings behind an
        apostrophe, and encodes each by itself. Between a letter or digit of ASCII and a sign other than the apostrophe
        there always is such a split, so the ids of the parts side by side are those of the word.
        """
        plain = list(filter(self.merges.PLAIN.fullmatch, words))
        known = dict(zip(plain, self.merges.ids(plain)))
        if len(plain) == len(words):
            return list(map(known.__getitem__, words))
        known[b""] = b""
        young, old, split, edge = self.young, self.old, self._EDGES.fullmatch, self._HAS_EDGE.search
        parts, todo = {}, {}
        for w in words:
            if w in known:
                continue
            part = (w,)
            if edge(w) and b"<|" not in w:
                a, core, c = split(w).groups()
                if core and _is_plain(core[0]) and _is_plain(core[-1]):
                    part = (a, core, c)
            parts[w] = part
            for x in part:
                if x not in known:
                    got = young.get(x) or old.get(x)
                    if got:
                        known[x] = got
                    else:
                        todo[x] = None
        known.update(zip(todo, self._ids(list(todo))))
        find = known.__getitem__
        known.update([(w, b"".join(map(find, part))) for w, part in parts.items() if len(part) > 1])
        return list(map(find, words))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words: plain ones by the merges, others by the library, many in one text with a special token between."""
        import numpy as np

        match = self.merges.PLAIN.fullmatch
        simple = [i for i, w in enumerate(words) if match(w)]
        out: dict[int, bytes] = dict(zip(simple, self.merges.ids([words[i] for i in simple])))
        plain = [i for i, w in enumerate(words) if i not in out and b"<|" not in w]
        runs = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        texts = [self._MARK.join(words[i].decode("utf-8") for i in run) for run in runs]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
            out.update(zip(run, (data[lo:hi] for lo, hi in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)]))))
        rest = [i for i in range(len(words)) if i not in out]
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode("utf-8") for i in rest], add_special_tokens=False)):
            out[i] = np.array(got.ids, dtype="<u4").tobytes()
        return [out[i] for i in range(len(words))]


class SegmentCounts(_Remembered):
    """Number of tokens of texts under a byte-level tokenizer.

    A text is cut where a character that is no white space stands before a blank or line end. No token of such a
    tokenizer goes over that place and no rule looks back over it, so the counts of the segments add up to the count of
    the text. Texts with other kinds of white space are encoded as a whole.
    """

    _SEGMENT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
    _OTHER_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")

    def count(self, texts: list[str | None]) -> list[int]:
        self._make_room()
        find = self._SEGMENT.findall
        split = [[t] if self._OTHER_SPACE.search(t) else find(t) for t in (t or "" for t in texts)]
        self._learn(set().union(*split), self._count_segments)
        get = self.young.__getitem__
        return [sum(map(get, segments)) for segments in split]

    def _count_segments(self, segments: list[str]) -> list[int]:
        """A segment that ends in an ASCII letter and one comma or full stop is its stem and that sign."""
        stems = [s[:-1] if len(s) > 1 and s[-1] in ".," and s[-2].isascii() and s[-2].isalpha() else s for s in segments]
        bare = {k for k, s in zip(stems, segments) if k is not s}
        known = {}
        for k in bare:
            n = self.young.get(k)
            n = self.old.get(k) if n is None else n
            if n is not None:
                known[k] = n
        todo = [k for k in dict.fromkeys([*stems, ".", ","]) if k not in known]
        known.update(zip(todo, map(len, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False))))
        return [known[k] if k is s else known[k] + known[s[-1]] for k, s in zip(stems, segments)]

    def starts(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every token, in code points."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets
