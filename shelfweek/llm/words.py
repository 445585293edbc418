"""Words of whole Arrow columns of text, found by a table of bytes."""

from __future__ import annotations

import numpy as np


def byte_table(letters: bytes) -> bytes:
    """What becomes of each byte: A-Z lower case, bytes of other than ASCII characters and ``letters`` as they are, a
    space for the rest. A byte of a longer character is never taken for an ASCII one, so texts stay UTF-8."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in letters else 32 for b in range(256))


def split_column(column, table: bytes):
    """(words, sizes): the words of all texts of an Arrow string column without nulls as one Arrow array, some of them
    empty, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(column):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    plain = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(table) if data is not None else b""
    clean = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain))
    split = pc.ascii_split_whitespace(clean)
    return split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)


def encode(chunks: list, sizes: np.ndarray):
    """(different words, number of each word among them, words of each text), empty words left out."""
    import pyarrow as pa

    if not chunks:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64), sizes
    coded = pa.chunked_array(chunks, pa.string()).dictionary_encode()
    coded = coded.unify_dictionaries()
    words = coded.chunk(coded.num_chunks - 1).dictionary
    ids = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    empty = words.index("").as_py()
    if empty >= 0:
        kept = ids != empty
        text = np.repeat(np.arange(len(sizes)), sizes)[kept]
        ids, sizes = ids[kept], np.bincount(text, minlength=len(sizes))
    return words, ids, sizes
