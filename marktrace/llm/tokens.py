"""Token counts by rank-synchronous array merging, and cached token ids of whole texts."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import frugal, portions, whole_text

#: pieces remembered by a worker before it starts afresh
CACHE_PIECES = 400_000
NO_RANK = np.iinfo(np.int64).max
#: pre-token pattern of byte-level vocabularies, published with them
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same of vocabularies of words, without white space
WORD_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
TWO_SPACES = re.compile(r"\s\s")


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; a path with a slash is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.byte_id = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.special = [t["content"] for t in model["added_tokens"]]

    def counts(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each pre-token.

        All pre-tokens lie in one ragged array. In each round every one applies its lowest-ranked pair at
        all places at once, left to right where places overlap; those without a ranked pair leave the array.
        """
        length = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        result = np.zeros(len(pre_tokens), dtype=np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pre_tokens)), length)
        while len(symbol):
            first = np.r_[True, owner[1:] != owner[:-1]]
            starts, place = np.flatnonzero(first), np.cumsum(first) - 1
            pair = (symbol[:-1] << 32) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & ~first[1:]
            rank = np.append(np.where(known, self.rank[at], NO_RANK), NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            here = np.flatnonzero((rank == lowest[place]) & (rank != NO_RANK))
            if len(here):
                n = np.arange(len(here))
                run = np.maximum.accumulate(np.where(np.r_[True, np.diff(here) != 1], n, 0))
                here = here[(n - run) % 2 == 0]
                symbol[here] = self.merged[at[here]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[here + 1] = False
            over = lowest == NO_RANK
            if over.any():
                size = np.diff(np.append(starts, len(symbol)))
                result[owner[starts[over]]] = size[over]
                keep &= ~over[place]
            symbol, owner = symbol[keep], owner[keep]
        return result


#: a full stop or comma after something that is neither letter nor digit; begins with the mark, which is quick to search
MARK_AFTER_MARK = re.compile(r"[.,]\s(?<=[\W_][.,]\s)")


class _Numbers(dict):
    """Numbers keys in the order they are first asked for; ``new`` lists those not worked on yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class TokenCounter:
    """Counts tokens of texts; remembers short pieces between calls."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = re.compile("|".join(map(re.escape, self.table.special))) if self.table.special else None
        self.reset()

    def reset(self) -> None:
        self.number, self.size = _Numbers(), np.zeros(1 << 16, dtype=np.int64)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pieces whose counts add up to the count of ``text``, and the special tokens in it.

        White space of one character between others never joins what is around it, and a full stop or comma
        never joins a letter or digit, so other texts than those with neighbouring white space can be cut
        before each space, around line ends and before such marks. The rest is cut by the pre-token pattern.
        """
        extra, parts = 0, [text]
        if self.special and self.special.search(text):
            extra, parts = len(self.special.findall(text)), self.special.split(text)
        out: list[str] = []
        for part in parts:
            if "\x00" in part or TWO_SPACES.search(part):
                out += self.pattern.findall(part)
                continue
            marks = not MARK_AFTER_MARK.search(part)
            part = part.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")
            if marks:
                part = part.replace(".\x00", "\x00.\x00").replace(",\x00", "\x00,\x00")
            out += part.split("\x00")
        return out, extra

    def learn(self) -> None:
        """Counts of the new pieces, all their distinct pre-tokens merged together."""
        new, self.number.new = self.number.new, []
        first = len(self.number) - len(new)
        while len(self.size) < len(self.number):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        cut = [self.pattern.findall(p) for p in new]
        pre = list({t for c in cut for t in c})
        size = dict(zip(pre, self.table.counts([t.encode("utf-8", "surrogatepass") for t in pre]).tolist(), strict=True)) if pre else {}
        self.size[first : len(self.number)] = [sum(map(size.__getitem__, c)) for c in cut]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.number) > CACHE_PIECES:
            self.reset()
        cut = [self.pieces(t) for t in texts]
        sizes = np.fromiter((len(p) for p, _ in cut), dtype=np.int64, count=len(cut))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(p for p, _ in cut)), dtype=np.int64, count=int(sizes.sum()))
        self.learn()
        upto = np.append(0, np.cumsum(self.size[at]))[np.append(0, np.cumsum(sizes))]
        return (np.diff(upto) + np.array([extra for _, extra in cut], dtype=np.int64)).tolist()


def _latin(text: str) -> bool:
    """Whether all characters are below 256: none of them composes, and lowering looks at one at a time."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def plain(piece: str) -> bool:
    """Whether lowering, composing and white-space rules leave ``piece`` as it is, and no special string is in it."""
    return piece.isprintable() and "<" not in piece and piece == piece.lower() and _latin(piece)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """``array`` doubled until it has ``n`` places."""
    while len(array) < n:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class TokenIds:
    """Token ids of texts by the library, run once per distinct white-space-free piece.

    Only for vocabularies that drop white space before merging and never join a letter or digit with a full
    stop or comma: there a text can be cut at spaces, line ends and before such marks. Plain pieces are cut by
    ``WORD_TOKEN`` and go through the library without its normalizer and pattern, where both ways agree on
    pieces of all characters that plain ones can have; the others go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pattern = regex.compile(WORD_TOKEN)
        vocab, suffix = self.library.get_vocab(), getattr(self.library.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        self.closing[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        probe = [piece for c in map(chr, range(256)) if plain(c) for piece in (c, f"a{c}b", f"1{c}2", f".{c}'s", f"{c}{c}!", f"\u00e9{c}'{c}")]
        self.agree = bool(suffix) and all(np.array_equal(a, b) for a, b in zip(self.by_words(probe), self.by_library(probe), strict=True))
        self.reset()

    def reset(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.met = np.zeros(1 << 16, dtype=np.int32)  # calls that a piece was in

    def forget(self) -> None:
        """Start afresh with the pieces met again since the last time, half of ``CACHE_PIECES`` at most."""
        met = self.met[: len(self.number)]
        again = np.flatnonzero(met > 1)
        if len(again) > CACHE_PIECES // 2:
            again = again[np.argpartition(-met[again], CACHE_PIECES // 2)[: CACHE_PIECES // 2]]
        names, size, flat = list(self.number), self.size[again], self.gather(again)
        self.reset()
        if len(flat) > 8 * CACHE_PIECES:
            return
        self.number.update(zip((names[i] for i in again.tolist()), range(len(again)), strict=True))
        self.keep(np.arange(len(again)), flat, size)
        self.met[: len(again)] = 1

    def keep(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """``ids`` are those of the pieces with the numbers ``at``, ``size`` of them each."""
        n = len(self.number)
        self.start, self.size, self.met = _room(self.start, n), _room(self.size, n), _room(self.met, n)
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the pieces with the numbers ``at``, end to end."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def by_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces and how many each has; words are told apart by the ids that end them."""
        cut = [[p] if p.isalpha() else self.pattern.findall(p) for p in pieces]
        encoding = self.words.encode_batch_fast([" ".join(chain.from_iterable(cut))], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, dtype=np.uint32)
        ends = np.append(0, np.flatnonzero(self.closing[ids]) + 1)
        words = np.append(0, np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))))
        if len(ends) - 1 != words[-1]:
            return self.by_library(pieces)
        return ids, np.diff(ends[words])

    def by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces and how many each has; pieces are told apart by offsets."""
        begin = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
        encoding = self.library.encode(" ".join(pieces), add_special_tokens=False)
        ids = np.array(encoding.ids, dtype=np.uint32)
        place = np.fromiter((o[0] for o in encoding.offsets), dtype=np.int64, count=len(ids))
        return ids, np.bincount(np.searchsorted(begin, place, "right") - 1, minlength=len(pieces))

    def learn(self) -> None:
        """Ids of the new pieces; many pieces go through the library as one text."""
        new, self.number.new = self.number.new, []
        first = len(self.number) - len(new)
        short = np.fromiter(map(plain, new), dtype=bool, count=len(new)) & self.agree
        for encode, chosen in ((self.by_words, np.flatnonzero(short)), (self.by_library, np.flatnonzero(~short))):
            for i in range(0, len(chosen), 2_000):
                at = chosen[i : i + 2_000]
                self.keep(first + at, *encode([new[k] for k in at.tolist()]))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE_PIECES or self.used > 16 * CACHE_PIECES:
            self.forget()
        spaced = []
        for text in texts:
            text, latin = text.replace("\n", " ") + " ", _latin(text)
            # composed and lowered, some letters end with a mark that joins the next one
            if not MARK_AFTER_MARK.search(text if latin else unicodedata.normalize("NFC", text).lower()):
                text = text.replace(". ", " . ").replace(", ", " , ")
            if latin and "<" not in text:  # the vocabulary lowers letters; special strings keep their case
                text = text.lower()
            spaced.append(text)
        cut = pc.split_pattern(pa.array(spaced, pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.number.__getitem__, names), dtype=np.int64, count=len(names))
        self.learn()
        self.met[known] += 1
        at = known[coded.indices.to_numpy()]
        bounds = np.append(0, np.cumsum(self.size[at]))[cut.offsets.to_numpy()].tolist()
        flat = self.gather(at)
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_LOADED: dict = {}


def loaded(kind: type, name: str):
    """One instance per worker process and vocabulary."""
    if (kind, name) not in _LOADED:
        _LOADED[kind, name] = kind(vocabulary(name))
    return _LOADED[kind, name]


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row per input row, repeated ids included; a null text counts as empty and has no tokens. Special
    strings inside a text are one token each, as the library does by default. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(TokenCounter, name)
        for batch in batches:
            n: list[int] = []
            for _, texts in portions(batch.column("text")):
                n += counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sized = slim.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(frugal(count), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
