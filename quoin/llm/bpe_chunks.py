"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text into chunks whose borders
depend on nearby bytes only, so passages that documents share give the same
chunks wherever they stand. A chunk is encoded once while it stays in the
worker's cache. A cut may fall inside a word: the chunk's outer word pieces
are left open, and each join is repaired by encoding the word across it, over
as many chunks as it takes to reach white space on both sides. From there on a
wider neighbourhood gives the same tokens, since no token spans white space:
``parts_at_space`` proves that from the vocabulary's own rules, and any other
vocabulary is refused. So the result agrees with encoding the whole text.

Caches live in one task and are bounded by bytes. Null texts count as empty (no
tokens); an empty table gives an empty result; repeated rows repeat their
result. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, struct, text_bytes

#: Mean chunk length in bytes is 2 ** CHUNK_BITS.
CHUNK_BITS = 7
#: Bytes that one of the two generations of a worker's words and chunks may hold, and what an entry takes beside its key.
WORD_BYTES, CHUNK_BYTES, ENTRY_BYTES = 24 << 20, 8 << 20, 300
#: White space at which words may be parted: it never joins with what stands beside it.
_SPACE = re.compile(rb"[ \t\n\r]")
#: Punctuation that never joins with the letters before it (an apostrophe may).
_CLOSING = b".,!?;:%&*$#"
_GEAR = np.random.default_rng(20240517).integers(0, 2**32, 256, dtype=np.uint32)


def default_vocabulary() -> str:
    """The place of the public word-end vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each position, by doubling: four bytes an element."""
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def chunk_cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the content-defined chunks; the last is the end of the text. Characters stay whole."""
    if not data:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    hit = np.flatnonzero(rolling_hash(raw) >> np.uint32(32 - bits) == 0) + 1
    hit = hit[hit < len(raw)]
    return [*hit[raw[hit] & 0xC0 != 0x80].tolist(), len(raw)]


class _Held:
    """Encodings in two generations: what is used again moves to the younger one, the older is dropped when that is full."""

    def __init__(self, limit: int):
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.limit, self.size = limit, 0

    def turn(self) -> None:
        """Between slices: bound both generations by their bytes."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0

    def find(self, key: bytes) -> tuple | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: bytes, value: tuple) -> None:
        self.young[key] = value
        self.size += ENTRY_BYTES + len(key)

    def put_all(self, keys: list[bytes], values: Iterable[tuple]) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.size += ENTRY_BYTES * len(keys) + sum(map(len, keys))

    def lacking(self, keys: set[bytes]) -> set[bytes]:
        """Keys that neither generation holds; those in the older one move to the younger."""
        keys, old = keys.difference(self.young), self.old
        back = [k for k in keys if k in old]
        self.put_all(back, [old[k] for k in back])
        return keys.difference(back)


def parts_at_space(spec: dict) -> bool:
    """Whether a vocabulary surely gives words between white space the same tokens wherever they stand.

    It must lower case, read white space as a blank, drop it in the split into words, and merge
    inside words only; then a join is exact once it reaches white space on both sides.
    """
    steps = spec["normalizer"] or {}
    steps = steps.get("normalizers", [steps])
    plain = all(x.get("type") in ("NFC", "Lowercase") or x.get("type") == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    split = spec["pre_tokenizer"] or {}
    split = split.get("pretokenizers", [split])
    first = split[0].get("pattern", {}).get("Regex", r"\s")
    parted = split[0].get("behavior") == "Removed" and split[0].get("invert") and not regex.search(first, " \t\n\r")
    later = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in split[1:])
    letters = regex.findall(first, "word.,!?;:%&*$#") == ["word", ".,!?;:%&*$#"]
    return bool(plain and any(x.get("type") == "Lowercase" for x in steps) and parted and later and letters and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]) and spec["decoder"] is None)


class ChunkEncoder:
    """Encodes texts to strings of ids and of tokens, each joined by one space; only counts with ``counts_only``."""

    def __init__(self, vocabulary: str, bits: int = CHUNK_BITS, counts_only: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.counts_only = bits, counts_only
        spec = json.loads(self.tokenizer.to_str())
        if not parts_at_space(spec):
            raise ValueError("chunk joins are exact only for vocabularies that lower case, part words at white space and have no decoder")
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.id_texts = [] if counts_only else [str(i) for i in range(size)]
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.id_tokens = [] if counts_only else tokens
        #: Bytes of text that each token stands for (byte-level tokens have one character a byte); none counts as too many for any word.
        mark, unknown = spec["model"].get("end_of_word_suffix") or "", spec["model"].get("unk_token")
        self.id_bytes = np.array([1 << 40 if t == unknown or not t else len(t.removesuffix(mark)) for t in tokens], dtype=np.int64)
        self.held_words, self.held_chunks = _Held(WORD_BYTES), _Held(CHUNK_BYTES)
        self.words = self.held_words.young
        self.encoded_chunks = self.reused_chunks = 0

    def learn(self, words: set[bytes]) -> None:
        """Encode words that the cache lacks.

        An ASCII word with closing punctuation gives the tokens of its lower-case letters and
        of the punctuation: the vocabulary lowers case and parts both anyway.
        """
        parted, plain = {}, set()
        for word in self.held_words.lacking(words):
            core = word.rstrip(_CLOSING)
            if core.isalpha() and (low := core.lower()) != word:
                parted[word] = (low, word[len(core) :])
                plain.update(parted[word])
            else:
                plain.add(word)
        plain.discard(b"")
        new = self.held_words.lacking(plain)
        self._encode([w for w in new if w.isascii()], True)
        self._encode([w for w in new if not w.isascii()], False)
        held, made = self.words, []
        for low, rest in parted.values():
            a = held[low]
            b = held[rest] if rest else (0, "", "")
            made.append((a[0] + b[0], f"{a[1]} {b[1]}", f"{a[2]} {b[2]}") if b[0] else a)
        self.held_words.put_all(list(parted), made)

    def _encode(self, new: list[bytes], ascii_only: bool) -> None:
        """Encode words, a thousand in one call."""
        for at in range(0, len(new), 1000):
            words = new[at : at + 1000]
            part = [w.decode("utf-8", "surrogatepass") for w in words]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            found = got.ids
            ends = self._ends(found, part) if ascii_only else None
            if ends is None:
                starts = np.cumsum([len(w) + 1 for w in part])
                first = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(found))
                ends = np.searchsorted(first, starts)
            begins = [0, *ends[:-1].tolist()]
            if self.counts_only:
                self.held_words.put_all(words, zip(np.diff(ends, prepend=0).tolist(), repeat(""), repeat("")))
                continue
            ids, tokens = [self.id_texts[i] for i in found], [self.id_tokens[i] for i in found]
            self.held_words.put_all(words, [(end - begin, " ".join(ids[begin:end]), " ".join(tokens[begin:end])) for begin, end in zip(begins, ends.tolist(), strict=True)])

    def _ends(self, found: list[int], part: list[str]) -> np.ndarray | None:
        """Where each word's tokens end, from the bytes they stand for; None unless these agree at the end of every word.

        Lowering keeps the length of ASCII words, and white space that is dropped or an
        unknown character only takes away or adds: equal sums are the words' own tokens.
        """
        upto = np.cumsum(self.id_bytes[found])
        want = np.cumsum([len(w) for w in part])
        last = np.searchsorted(upto, want)
        return last + 1 if len(upto) and upto[-1] == want[-1] and (upto[last] == want).all() else None

    def _cut(self, data: bytes) -> list[bytes]:
        at, out = 0, []
        for end in chunk_cuts(data, self.bits):
            out.append(data[at:end])
            at = end
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """(tokens, ids, token strings) of each text."""
        self.held_words.turn()
        self.held_chunks.turn()
        self.words = self.held_words.young
        find = self.held_chunks.find
        parts: dict[bytes, tuple[bytes, list[bytes], bytes] | None] = {}
        plans: list[list[tuple[bool, bytes]]] = []
        wanted: set[bytes] = set()
        for data in texts:
            carry, plan = b"", []
            for chunk in self._cut(data):
                held = find(chunk)
                if held is not None:
                    self.reused_chunks += 1
                    head, tail = held[0], held[1]
                else:
                    if chunk not in parts:
                        self.encoded_chunks += 1
                        pieces = _SPACE.split(chunk)
                        parts[chunk] = (pieces[0], [p for p in pieces[1:-1] if p], pieces[-1]) if len(pieces) > 1 else None
                        if parts[chunk]:
                            wanted.update(parts[chunk][1])
                    else:
                        self.reused_chunks += 1
                    if parts[chunk] is None:  # no white space: the join goes on
                        carry += chunk
                        continue
                    head, tail = parts[chunk][0], parts[chunk][2]
                if joined := carry + head:
                    plan.append((True, joined))
                    wanted.add(joined)
                plan.append((False, chunk))
                carry = tail
            if carry:
                plan.append((True, carry))
                wanted.add(carry)
            plans.append(plan)
        self.learn(wanted)
        words, chunks = self.words, self.held_chunks.young
        for chunk, part in parts.items():
            if part:
                got = [words[w] for w in part[1]]
                self.held_chunks.put(chunk, (part[0], part[2], self._sum(got)))
        return [self._sum([words[key] if is_word else chunks[key][2] for is_word, key in plan]) for plan in plans]

    def _sum(self, got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        if self.counts_only:
            return sum([g[0] for g in got]), "", ""
        if not got:
            return 0, "", ""
        counts, ids, tokens = zip(*got, strict=True)
        if 0 in counts:
            ids, tokens = [g[1] for g in got if g[0]], [g[2] for g in got if g[0]]
        return sum(counts), " ".join(ids), " ".join(tokens)


ENCODED = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, keep: bool = False) -> DataFrame:
    """Token counts and digests of every whole text; with ``keep`` also the ids and the decoded text.

    A missing or null text has no token and the digests of the empty string.
    Rows are independent: repeated rows give repeated results.
    """
    place = vocabulary or default_vocabulary()
    extra = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())] if keep else []
    schema = struct(("doc_id", T.LongType()), *ENCODED, *extra)

    def make():
        encoder = ChunkEncoder(place)

        def step(cols):
            got = encoder.encode([text_bytes(t) for t in cols["text"]])
            out = {"doc_id": cols["doc_id"], "n_tokens": [g[0] for g in got]}
            out["ids_sha256"] = [hashlib.sha256(g[1].encode()).hexdigest() for g in got]
            out["decoded_sha256"] = [hashlib.sha256(g[2].encode()).hexdigest() for g in got]
            if keep:
                out["ids"] = [list(map(int, g[1].split())) for g in got]
                out["decoded"] = [g[2] for g in got]
            return out

        return step

    return arrow_map(docs, ["doc_id", "text"], make, schema)


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; ids and tokens are not written out."""
    place = vocabulary or default_vocabulary()

    def make():
        encoder = ChunkEncoder(place, counts_only=True)
        return lambda cols: {"doc_id": cols["doc_id"], "n_tokens": [g[0] for g in encoder.encode([text_bytes(t) for t in cols["text"]])]}

    return arrow_map(docs, ["doc_id", "text"], make, struct(("doc_id", T.LongType()), ENCODED[0]))
