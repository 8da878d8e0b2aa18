"""Word lists of scripts without spaces, from public dictionaries."""

from __future__ import annotations

import functools
import struct

from pyspark.sql import SparkSession

#: The Java runtime's own Thai dictionary, which its break iterators use.
_RESOURCE = "/modules/jdk.localedata/sun/text/resources/ext/thai_dict"
_THAI = range(0x0E01, 0x0E50)
_MISSING = "no Thai dictionary can be read from the Java runtime (module jdk.localedata); pass words, or an empty list to do without"


def from_file(path: str) -> frozenset[str]:
    """Words of a text file, one a line; what follows a tab is left out."""
    with open(path, encoding="utf-8") as f:
        return frozenset(w for line in f if (w := line.split("\t")[0].strip()))


@functools.lru_cache(maxsize=1)
def _runtime(spark: SparkSession) -> frozenset[str]:
    jvm = spark._jvm
    try:
        file = jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(f"jrt:{_RESOURCE.removeprefix('/modules')}"))
        data = bytes(jvm.java.nio.file.Files.readAllBytes(file))
        words = frozenset(_words(data))
    except Exception as e:  # a runtime without the module, or with another form of it
        raise RuntimeError(_MISSING) from e
    if not words:
        raise RuntimeError(_MISSING)
    return words


def thai(spark: SparkSession) -> frozenset[str]:
    """Thai words of the driver's Java runtime; raises where it has no such dictionary or one that can't be read."""
    return _runtime(spark)


def _words(data: bytes) -> list[str]:
    """All words of a compiled dictionary: the paths of its state table, from state 0 to a state that may end a word."""
    at = 0

    def numbers(form: str, n: int | None = None) -> tuple[int, ...]:
        nonlocal at
        if n is None:
            (n,) = struct.unpack_from(">i", data, at)
            at += 4
        out = struct.unpack_from(f">{n}{form}", data, at)
        at += n * struct.calcsize(f">{form}")
        return out

    numbers("i", 2)  # version and size
    index, columns = numbers("h"), numbers("b")
    width, _ = numbers("i", 2)
    rows, flags_at, flags, shifts, table = numbers("h"), numbers("h"), numbers("i"), numbers("b"), numbers("h")
    letters: dict[int, list[str]] = {}
    for c in _THAI:
        letters.setdefault(columns[(index[c >> 7] & 0xFFFF) + (c & 0x7F)], []).append(chr(c))

    def following(state: int):
        """(column, next state) of a state's populated columns."""
        f, base = flags_at[state], rows[state] * width + shifts[state]
        there = [-f] if f < 0 else [32 * i + b for i in range(-(-width // 32)) for b in range(32) if flags[f + i] >> b & 1]
        return [(c, table[base + c]) for c in there]

    found, todo = [], [(0, "")]
    while todo:
        state, word = todo.pop()
        for col, to in following(state):
            if col == 0 and to == -1 and word:
                found.append(word)
            elif to > 0:
                todo += [(to, word + c) for c in letters.get(col, ())]
    return found
