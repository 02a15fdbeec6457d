"""Two levels of chunks: sections by heading, and windows of a byte budget within them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*$")
_FENCE = re.compile(r"\s{0,3}(```|~~~)")
#: A chunk begins with the last tenth of the budget of the one before; bytes a token is taken for, and tokens
#: of a model's window that are left free.
OVERLAP, TOKEN_BYTES, FREE_TOKENS = 10, 3, 64


def byte_budget(tokens: int) -> int:
    """The bytes that fit into a model's window."""
    return (tokens - FREE_TOKENS) * TOKEN_BYTES


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(path of headings, content with its own heading) of each section that is not blank. Headings in fences are none.
    A level that was left out has no part in the path."""
    path: dict[int, str] = {}
    held: list[str] = []
    fenced = False
    for line in [*text.split("\n"), None]:
        fence = line is not None and _FENCE.match(line)
        heading = None if line is None or fence or fenced else _HEADING.match(line)
        if line is None or heading:
            content = "\n".join(held).rstrip("\n")
            if content.strip():
                yield " > ".join(path[k] for k in sorted(path) if path[k]), content
            held = []
        if heading:
            level = len(heading[1])
            path = {k: v for k, v in path.items() if k < level} | {level: heading[2]}
        if fence:
            fenced = not fenced
        if line is not None:
            held.append(line)


def _back(data: bytes, at: int) -> int:
    """The start of the character that byte ``at`` belongs to."""
    at = min(max(at, 0), len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(title: str, body: str, budget: int) -> list[str]:
    """Title and body as one chunk if they fit into ``budget`` bytes, else the title on each of the pieces that the body
    fills the rest with. A title that leaves no room gives one chunk, cut off at the budget. Characters stay whole."""
    title, body = title.strip(), body.strip()
    whole = "\n\n".join(x for x in (title, body) if x)
    if budget <= 0 or len(whole.encode()) <= budget:
        return [whole]
    prefix = f"{title}\n\n" if title else ""
    room = budget - len(prefix.encode())
    if room <= 0:
        data = whole.encode()
        return [data[: _back(data, budget)].decode()]
    data, start, out = body.encode(), 0, []
    while start < len(data):
        end = _back(data, start + room)
        if end <= start:  # a character wider than the room
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append(prefix + data[start:end].decode())
        if end == len(data):
            break
        again = _back(data, end - room // OVERLAP)
        start = again if again > start else end
    return out or [whole]


#: Bytes of a batch that goes to Python, about; a worker holds a small multiple of it, however long the texts are.
BATCH_BYTES = 4 << 20


def rows_of(docs: DataFrame, columns: list, key: str, schema: str, make) -> DataFrame:
    """(key, and the columns of ``schema``): the rows that ``make`` gives for the texts of each row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    names = [key, *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [(k, *row) for k, *values in zip(*(c.to_pylist() for c in some.columns)) for row in make(*(v or "" for v in values))]
                if found:
                    kinds = [some.schema.field(0).type, *(pa.int32() if f.endswith(" int") else pa.string() for f in schema.split(", "))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, *columns).mapInArrow(run, f"{key} {kind}, {schema}")


def window_chunks(docs: DataFrame, title: str, body: str, key: str, budget: int) -> DataFrame:
    """(key, chunk_idx, content): ``windows`` of each note. Null titles and bodies are empty; a note that has neither is
    one empty chunk. No budget (0) leaves notes whole."""
    return rows_of(docs, [title, body], key, "chunk_idx int, content string", lambda t, b: enumerate(windows(t, b, budget)))


def build_chunks(docs: DataFrame, title: str, body: str, key: str, budget: int = 0) -> DataFrame:
    """(key, chunk_idx, header_path, content): windows within sections, numbered through. Without a budget the sections
    stay as they are, without title. A body that is null, empty or blank has no chunks."""

    def make(t: str, b: str) -> Iterator[tuple[int, str, str]]:
        pieces = ((path, piece) for path, content in sections(b) for piece in (windows(t, content, budget) if budget > 0 else [content]))
        return ((i, *p) for i, p in enumerate(pieces))

    return rows_of(docs, [title, body], key, "chunk_idx int, header_path string, content string", make)
