"""Token ids of whole texts by the tokenizers library, with a bounded memo of word pieces in each worker."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Memo entries in one worker (about 200 bytes each), so that its memory is bounded: half of them are the newest, half those before.
MEMO_ENTRIES = 1_000_000
#: Pieces that are encoded in one call.
PIECES_A_CALL = 512
#: Ids that are put in the order of their texts at once, unless a single text has more.
IDS_A_GROUP = 1 << 19

_ODD_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: For RE2: texts that pieces() does not cut at every space.
_ODD_TEXT = "  |\\n | \\n|\\A | \\z|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    """Ids as Tokenizer.encode gives them for the whole text.

    Byte-level pre-tokenizers always cut before a single space between two visible characters, so the ids of a
    text are those of its pieces (each but the first with its space), one after the other. Pieces recur, so each
    is encoded once. A tokenizer of another kind is given whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and not any(" " in a["content"] or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        )
        self.odd = re.compile("|".join(["^$", r"\s", *(re.escape(a["content"]) for a in added)]))
        if self.by_piece:
            vocab = self.tokenizer.get_vocab()
            self.starts = np.zeros(max(vocab.values()) + 1, bool)
            self.starts[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = MEMO_ENTRIES

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
            return _SAFE_SPACE.split(text)
        return text.split(" ")

    def _learn(self, missing: list[str]) -> None:
        """Encodes pieces many at a time: a piece without white space begins at the one token that begins with a space."""
        odd = list(filter(self.odd.search, missing))
        if odd:
            self.memo.update(zip(odd, self._raw([" " + x for x in odd])))
            skip = set(odd)
            missing = [x for x in missing if x not in skip]
        groups = [missing[k : k + PIECES_A_CALL] for k in range(0, len(missing), PIECES_A_CALL)]
        for some, raw in zip(groups, self._raw([" " + " ".join(some) for some in groups])):
            at = (np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")]) * 4).tolist()
            if len(at) != len(some):
                self.memo.update(zip(some, self._raw([" " + x for x in some])))
                continue
            self.memo.update(zip(some, [raw[i:j] for i, j in zip(at, at[1:] + [len(raw)])]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        if not self.by_piece:
            return self._raw(texts)
        full = np.flatnonzero([bool(t) for t in texts])
        cuts = self._cut([texts[k] for k in full])
        n_pieces = pc.list_value_length(cuts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = cuts.flatten(), np.cumsum(n_pieces) - n_pieces
        later = np.ones(len(flat), bool)
        later[first] = False
        heads = self._raw(flat.take(pa.array(first)).to_pylist())
        words = flat.filter(pa.array(later)).dictionary_encode()
        del cuts, flat
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, at, codes = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, words.indices.to_numpy(zero_copy_only=False)
        lengths = size[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(n_pieces - 1)]  # of each text's ids, without its first piece
        out, done, piece, text = [b""] * len(texts), 0, 0, 0
        while text < len(full):
            upto = max(text + 1, int(np.searchsorted(ends, done + IDS_A_GROUP, "right")))
            stop = piece + int((n_pieces[text:upto] - 1).sum())
            some = lengths[piece:stop]
            where = np.repeat(at[codes[piece:stop]] - (np.cumsum(some) - some), some)
            where += np.arange(len(where))
            raw, begin = ids[where].tobytes(), done
            for k in range(text, upto):
                out[full[k]] = heads[k] + raw[4 * (done - begin) : 4 * (int(ends[k]) - begin)]
                done = int(ends[k])
            piece, text = stop, upto
        return out

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """The pieces of each text, as pieces() has them; Arrow cuts the texts that are cut at every space."""
        every = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(every, _ODD_TEXT).to_numpy(zero_copy_only=False))
        if not len(odd):
            return pc.split_pattern(every, " ")
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        apart = pa.array([self.pieces(texts[k]) for k in odd], pa.list_(pa.large_string()))
        return pa.concat_arrays([pc.split_pattern(every.take(pa.array(plain)), " "), apart]).take(pa.array(np.argsort(np.concatenate((plain, odd)))))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces with their space, from the memo or learnt."""
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        found = [*map(memo.get, words)]
        missing = [w for w, raw in zip(words, found) if raw is None]
        if not missing:
            return found
        again = {w: raw for w in missing if (raw := older.get(w)) is not None}
        memo.update(again)
        self._learn([w for w in missing if w not in again])
        return [raw if raw is not None else memo[w] for w, raw in zip(words, found)]

    def forget(self) -> None:
        self.memo.clear()
        self.older.clear()
