"""Byte-pair merging over ragged numpy arrays: every pre-token of a batch takes its
lowest-rank merge in the same round."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> (rank, merged id), an open-addressed numpy table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(left) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; -1 where the pair doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        todo = np.flatnonzero((got != keys) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != -1)]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges ragged sequences to the end; returns the surviving symbols and lengths.

    Each round applies, in every sequence, its lowest-rank pair: all of its places from
    left to right, unless a merge would create a pair of no higher rank, when it takes
    the leftmost place only. That is the order of a queue by (rank, position)."""
    n = len(lengths)
    out_len = lengths.astype(np.int64).copy()
    done_sym: list[np.ndarray] = []
    done_seq: list[np.ndarray] = []
    seq = np.repeat(np.arange(n), lengths)
    sym = symbols.astype(np.int32, copy=True)
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        same = np.flatnonzero(seq[1:] == seq[:-1])
        rank[same] = table.ranks(sym[same], sym[same + 1])
    while len(sym):
        begins = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        least = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.r_[begins, len(seq)])
        live = least != NONE
        if not live.all():
            stays = np.repeat(live, sizes)
            done_sym.append(sym[~stays])
            done_seq.append(seq[~stays])
            sym, seq, rank = sym[stays], seq[stays], rank[stays]
            least, sizes = least[live], sizes[live]
            if not len(sym):
                break
            begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == least[of])
        if len(at) > len(sizes):
            # overlapping places of a pair (a, a): every second one of a run
            fresh = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            own = of[at]
            several = np.bincount(own, minlength=len(sizes))[own] > 1
            first = np.r_[True, own[1:] != own[:-1]]
            check = np.flatnonzero(several)
            if len(check):
                i = at[check]
                new = table.merged[table.find(sym[i], sym[i + 1])]
                worst = least[own[check]]
                after = np.minimum(i + 2, len(sym) - 1)
                before = np.maximum(i - 1, 0)
                bad = (i + 2 < len(sym)) & (seq[after] == seq[i]) & (table.ranks(new, sym[after]) <= worst)
                bad |= (i > 0) & (seq[before] == seq[i]) & (table.ranks(sym[before], new) <= worst)
                bad |= table.ranks(new, new) <= worst
                unsafe = np.zeros(len(sizes), bool)
                unsafe[own[check[bad]]] = True
                at = at[first | ~unsafe[own]]
        new = table.merged[table.find(sym[at], sym[at + 1])]
        sym[at] = new
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        at = at - np.arange(len(at))
        mark = np.zeros(len(sym) + 1, bool)
        mark[at] = mark[at - 1] = True
        touched = np.flatnonzero(mark[:-1])
        inner = (touched + 1 < len(sym)) & (seq[np.minimum(touched + 1, len(sym) - 1)] == seq[touched])
        rank[touched[~inner]] = NONE
        inner = touched[inner]
        rank[inner] = table.ranks(sym[inner], sym[inner + 1])
    if not done_sym:
        return np.zeros(0, np.int32), out_len
    all_seq, all_sym = np.concatenate(done_seq), np.concatenate(done_sym)
    order = np.argsort(all_seq, kind="stable")
    return all_sym[order], np.bincount(all_seq, minlength=n).astype(np.int64)


class PieceModel:
    """Counts tokens as SentencePiece BPE with byte fallback does."""

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.processor = spm.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normalizer and a dummy prefix are counted here")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.chars = {c: k for k, c in enumerate(sorted({c for p in normal for c in p}))}
        self.ids = {p: len(self.chars) + i for p, (i, _) in normal.items()} | {c: k for c, k in self.chars.items()}
        self.known = np.zeros(len(self.chars), bool)
        for c, k in self.chars.items():
            self.known[k] = c in normal
        runs = {len(p) for p in normal if not p.strip(self.SPACE)}
        lows = {s for p, (_, s) in normal.items() if len(p) > 1 and not p.strip(self.SPACE)}
        # runs of spaces merge after all else, from the left
        if len(lows) > 1 or (lows and min(s for _, s in normal.values()) < min(lows)):
            raise ValueError("the pieces of spaces haven't the lowest score")
        self.run = max(runs, default=1)
        self.rest = np.array([_run_tokens(n, runs) for n in range(self.run)], np.int64)
        if any(_run_tokens(n, runs) != n // self.run + self.rest[n % self.run] for n in range(4 * self.run)):
            raise ValueError("runs of spaces don't repeat by the longest piece")
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        rows = []
        for p, (_, s) in normal.items():
            if p.strip(self.SPACE):
                rows += [(self.ids[p[:k]], self.ids[p[k:]], order[s], self.ids[p]) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.table = PairTable(*np.array(rows, np.int64).T)
        self.code = np.full(0x110000, -1, np.int32)
        for c, k in self.chars.items():
            self.code[ord(c)] = k
        spans = {(p[k], p[k + 1]) for p in normal for k in range(len(p) - 1)}
        self.spans = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in spans], np.int64))
        self.space = self.chars[self.SPACE]

    def counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk; a chunk is a run of spaces and the word after it, with
        the spaces as SPACE."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        if not lengths.sum():
            return np.zeros(len(chunks), np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        codes = self.code[points]
        weight = np.ones(len(points), np.int64)
        strange = codes < 0
        weight[strange] = 1 + (points[strange] > 0x7F) + (points[strange] > 0x7FF) + (points[strange] > 0xFFFF)
        # where no piece spans two neighbours nothing merges across them
        key = (points[:-1] << 21) | points[1:]
        slot = np.minimum(np.searchsorted(self.spans, key), len(self.spans) - 1)
        cut = np.r_[True, (self.spans[slot] != key) | (chunk[1:] != chunk[:-1])]
        symbols = np.where(strange, -1, codes)
        begins = np.flatnonzero(cut)
        sizes = np.diff(np.r_[begins, len(points)])
        total = np.zeros(len(chunks), np.int64)
        alone = sizes == 1
        np.add.at(total, chunk[begins[alone]], np.where(self._lone(symbols[begins[alone]]), weight[begins[alone]], 1))
        if not alone.all():
            inside = np.repeat(~alone, sizes)
            out, left = merge(self.table, symbols[inside], sizes[~alone])
            owner = np.repeat(chunk[begins[~alone]], left)
            piece = np.repeat(np.arange(len(left)), left)
            lone = self._lone(out)
            value = np.ones(len(out), np.int64)
            if lone.any():
                back = {k: len(c.encode()) for c, k in self.chars.items()}
                value[lone] = [back[k] for k in out[lone]]
            spaces = out == self.space
            if spaces.any():
                value[spaces] = 0
                at = np.flatnonzero(spaces)
                head = np.r_[True, (np.diff(at) != 1) | (piece[at[1:]] != piece[at[:-1]])]
                starts = np.flatnonzero(head)
                size = np.diff(np.r_[starts, len(at)])
                value[at[starts]] = size // self.run + self.rest[size % self.run]
            np.add.at(total, owner, value)
        return total

    def joins(self, char: str) -> bool:
        """Whether any piece of several characters has this one."""
        point = ord(char)
        return bool(((self.spans >> 21) == point).any() or ((self.spans & 0x1FFFFF) == point).any())

    def _lone(self, symbols: np.ndarray) -> np.ndarray:
        """Characters that occur in pieces but are none themselves, or strange ones."""
        small = (symbols >= 0) & (symbols < len(self.chars))
        lone = symbols < 0
        lone[small] = ~self.known[symbols[small]]
        return lone


def _run_tokens(n: int, pieces: set[int]) -> int:
    """Tokens of n spaces when the leftmost pair that makes a piece merges first."""
    parts = [1] * n
    while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in pieces), None)) is not None:
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return len(parts)


class ByteModel:
    """Ids of a byte-level BPE file of the tokenizers library, merged by rank."""

    #: Characters on which the libraries' Unicode tables can't differ; other words go to the library.
    SAFE = r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u2010-\u2027]"

    def __init__(self, path: str):
        import regex
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        letters = _byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        rows = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rows.append((vocab[a], vocab[b], r, vocab[a + b]))
        self.table = PairTable(*np.array(rows, np.int64).T)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.strange = regex.compile(self.SAFE)

    #: Words of letters alone, perhaps with one mark behind: pre-tokens by their look.
    PLAIN = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,]?$"

    def encode_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (words with the space before them, if any), flat, and lengths."""
        words = pa.array(chunks, pa.large_string())
        plain = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        kept = words.filter(pa.array(plain))
        sizes = pc.binary_length(kept).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.frombuffer(kept.buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
        marked = held[np.cumsum(sizes) - 1] < 0x30 if len(sizes) else np.zeros(0, bool)  # only "." and "," are that low at an end
        lengths = np.repeat(sizes, 1 + marked)
        ends = np.cumsum(1 + marked) - 1
        lengths[ends[marked] - 1] -= 1
        lengths[ends[marked]] = 1
        owner = np.repeat(np.flatnonzero(plain), 1 + marked)
        pieces: list[bytes] = []
        others: list[int] = []
        odd: list[tuple[int, list[int]]] = []
        find = self.pattern.findall
        for i in np.flatnonzero(~plain).tolist():
            c = chunks[i]
            if not c.isascii() and self.strange.search(c):
                odd.append((i, self.library.encode(c, add_special_tokens=False).ids))
                continue
            got = find(c)
            pieces += [p.encode() for p in got]
            others += [i] * len(got)
        symbols = self.first[np.r_[held, np.frombuffer(b"".join(pieces), np.uint8)]]
        ids, left = merge(self.table, symbols, np.r_[lengths, np.fromiter(map(len, pieces), np.int64, len(pieces))])
        owner = np.repeat(np.r_[owner, np.array(others, np.int64)], left)
        if odd:
            ids = np.r_[ids, np.array([t for _, x in odd for t in x], np.int32)]
            owner = np.r_[owner, np.repeat([i for i, _ in odd], [len(x) for _, x in odd])]
        out = np.bincount(owner, minlength=len(chunks)).astype(np.int64)
        if pieces or odd:
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself
    where printable in Latin-1, else the next letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + extra))
            extra += 1
    return out


#: Stands before a word that no space precedes.
BARE = "\x01"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at single spaces and line feeds: words of each text, distinct words,
    each word's place in them. A word has a space before it in the text, or starts with
    BARE, or is a line feed; the texts hold no BARE of their own."""
    marked = pc.binary_join_element_wise(pa.scalar(BARE, texts.type), pc.replace_substring(texts, "\n", f" \n {BARE}"), pa.scalar("", texts.type))
    lists = pc.split_pattern(marked, " ")
    coded = lists.flatten().dictionary_encode()
    return np.diff(lists.offsets.to_numpy()), coded.dictionary, coded.indices.to_numpy()


def chunk_of(word: str) -> str:
    """The text that a word of words_of stands for."""
    return word[1:] if word[:1] == BARE else word if word == "\n" else " " + word
