"""Words and shingles of many texts at once, as numpy arrays over an Arrow buffer."""

from __future__ import annotations

SPACES = (9, 10, 11, 12, 13, 32)
_M = 0x9E3779B97F4A7C15
_powers: list = [None, None]


def slices(column, most: int = 1 << 22):
    """(offset, BinaryArray) slices of an Arrow binary column, each of about `most` bytes or of a single longer text."""
    import numpy as np

    n, start = len(column), 0
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, column.slice(start, end - start)
        start = end


def binary(column):
    """An Arrow binary column, in one piece and with nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    return pc.fill_null(column, b"") if column.null_count else column


def raw(column):
    """(bytes, starts) of a BinaryArray: text i is bytes[starts[i]:starts[i + 1]]."""
    import numpy as np

    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return text, at - at[0]


def mixed(x):
    """A bijective scrambling of 64-bit numbers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int):
    """(powers, inverse powers) of the multiplier modulo 2**64, n of each at least."""
    import numpy as np

    if _powers[0] is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in ((0, _M), (1, pow(_M, -1, 1 << 64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers


def lowered(text):
    import numpy as np

    return np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)


def find_words(text, starts):
    """(first, end, doc) of each word: runs of bytes other than ASCII white space, within texts."""
    import numpy as np

    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    word = ~space[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    return first, end, np.searchsorted(starts, first, "right") - 1


def word_hashes(text, first, end):
    import numpy as np

    up, down = powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)])])
    return mixed((total[end] - total[first]) * down[first])


def shingle_hashes(words, doc, width: int):
    """(hash, doc) of each shingle of `width` words; a text of fewer words has one, of all its words."""
    import numpy as np

    n = len(words)
    if not n:
        return words, doc
    counts = np.bincount(doc)
    begin = np.concatenate([[0], np.cumsum(counts)])
    left = begin[doc + 1] - np.arange(n)  # words from here to the end of the text
    size = np.minimum(counts[doc], width)
    at = np.flatnonzero(left >= size)
    at = at[(left[at] >= width) | (at == begin[doc[at]])]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = size[at] > k
        step = words[np.minimum(at + k, n - 1)] * np.uint64(pow(_M, k + 2, 1 << 64))
        out += np.where(inside, step, np.uint64(0))
    return mixed(out + size[at].astype(np.uint64)), doc[at]
