"""Token ids of whole texts by the byte-level BPE vocabularies of tokenizer files, inside a task.

Both classes read a file of the ``tokenizers`` library and give that library's ids; merging itself runs in ``tiktoken``,
whose ranks are the file's ids. A file of another kind goes through ``tokenizers`` as it is.
"""

from __future__ import annotations

from shelfweek.llm.words import encode, split_column

#: Split pattern of the byte-level files and of the files with word ends, fixed by those files.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAME = bytes(range(256))
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"  # words whose lower case and parts are found here


def vocabulary_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such vocabularies write as they are
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """Ids of texts from a byte-level BPE file without normaliser or word ends."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        before, bpe, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        self.fast = (
            spec["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"]
            and not before["add_prefix_space"] and bpe["type"] == "BPE" and not bpe["dropout"]
            and not bpe["continuing_subword_prefix"] and not bpe["end_of_word_suffix"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        )
        if self.fast:
            byte = vocabulary_bytes()
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(byte[c] for c in t): i for t, i in bpe["vocab"].items() if t not in special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None):
        """The ids as a little-endian uint32 array."""
        import numpy as np

        if self.fast:
            found = self.ranked.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
        else:
            found = self.model.encode(text or "", add_special_tokens=False).ids
        return np.asarray(found, dtype="<u4")


class WordTokenizer:
    """Ids of whole texts from a byte-level file with word ends (NFC, lower case, no token across white space).

    A text is the run of its white-space-separated words, so the different words of some texts are taken apart by the
    file's split pattern together, a line break between them, and merged in one call; a text's ids are gathered
    from theirs. The end of a part is written as a zero byte: ``x</w>`` becomes ``x\\0``, which no plain word holds. Words
    with anything but printable ASCII and Latin letters, and files of another kind, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.fast = (
            kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": WORD_SPLIT}
            and spec["model"]["end_of_word_suffix"] == "</w>"
        )
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ÿ]+|[0-9]|\n|[^a-zß-ÿ0-9\n]+").findall
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 2, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>") and token[:-4].endswith((".", "!", "?"))
        if self.fast:
            byte, ranks = vocabulary_bytes(), {}
            for token, i in vocabulary.items():
                if token not in self.added:
                    whole = token.endswith("</w>") and token != "</w>"
                    ranks[bytes(byte[c] for c in (token[:-4] if whole else token)) + b"\0" * whole] = i
            self.ranked = tiktoken.Encoding("ranked", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[b"\n\0"]

    def _plain(self, words):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.fast:
            return pa.array([False] * len(words), pa.bool_())
        plain = pc.match_substring_regex(words, PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        return plain

    def encode(self, texts) -> list:
        """For each text its ids as a uint32 array."""
        import numpy as np
        import pyarrow as pa

        found, counts = split_column(pa.array([t or "" for t in texts], pa.string()), SAME)
        words, number, counts = encode([found], counts)
        plain = self._plain(words).to_numpy(zero_copy_only=False).astype(bool)
        size, ids = np.zeros(len(words), dtype=np.int64), []
        if plain.any():
            lines = "\n".join(words.filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist())
            merged = self.ranked.encode_to_numpy("\0".join(self.parts(lines.lower())) + "\0", disallowed_special=())
            stops = np.concatenate([[-1], np.flatnonzero(merged == self.line), [len(merged)]])
            size[plain] = np.diff(stops) - 1
            ids.append(merged[merged != self.line])
        if not plain.all():
            others = words.filter(pa.array(~plain)).to_pylist()
            encoded = [e.ids for e in self.model.encode_batch(others, add_special_tokens=False)]
            size[~plain] = [len(e) for e in encoded]
            ids += [np.array(e, dtype="<u4") for e in encoded if e]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *ids]).astype("<u4")
        start = np.zeros(len(words), dtype=np.int64)
        for kind in (plain, ~plain):  # in the order of ``ids``
            start[kind] = np.cumsum(size[kind]) - size[kind] + (size[plain].sum() if kind is not plain else 0)
        sizes = size[number]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(start[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])
        return np.split(flat, upto[np.cumsum(counts)][:-1]) if len(counts) else []
