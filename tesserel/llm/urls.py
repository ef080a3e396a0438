"""URL filters by a sorted digest array.

A blocklist of hosts and of host/path prefixes is kept as three arrays in files of the shared
folder: the sorted 64-bit xxhash keys of its entries, their strings end to end, and the
offsets of the strings. The list is sorted by Spark and written by its tasks, one file of
each kind for each range of keys, so that neither the driver nor a task holds all of it.
Executors memory-map the files, probe a whole batch of keys by one vectorised binary
search, and confirm every hit against the stored string, along the run of equal keys, so a
collision can't block a page.

Entries and URLs are spelled with the labels of the host from the top-level domain down,
``com.example.www/a/b``: the host, its parent domains of two labels or more (or its only
label) and the path's prefixes on the host itself are all prefixes of that one string, and
their keys come out of one pass of the hash over it.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserel.plans import shared

#: The entries of a file, one a line; TESSEREL_BLOCKLIST names another file.
with open(os.environ.get("TESSEREL_BLOCKLIST", os.path.join(os.path.dirname(__file__), "blocklist.txt")), encoding="utf-8") as _file:
    BLOCKLIST = tuple(x.strip() for x in _file if x.strip())
#: Entries in one range of keys.
RANGE_ROWS = 4_000_000
_URL = re.compile(r"\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:\[\]\s]+)(?::\d*)?(?=[/?#]|\s*$)([^?#\s]*)")


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """Labels of the host from the top-level domain down, and steps of the path; None without a host."""
    m = _URL.match(url or "")
    labels = [x for x in m[1].lower().rstrip(".").split(".")][::-1] if m else []
    return (labels, [x for x in m[2].split("/") if x]) if labels and all(labels) else None


def entry(text: str | None) -> str:
    """The form in which entries are stored: no scheme, no port, host from the top-level domain down, no closing slash; '' for what is no entry."""
    got = parts(text if text and "://" in text else f"http://{(text or '').strip()}")
    return "/".join([".".join(got[0]), *got[1]]) if got else ""


def shown(text: str) -> str:
    """A stored entry as users write it."""
    host, slash, path = text.partition("/")
    return ".".join(host.split(".")[::-1]) + slash + path


def candidates(url: str | None, digest=xxhash.xxh64) -> tuple[str, list[int], list[int]]:
    """A URL's spelling, the ends of the prefixes of it that would block it, and their keys; shortest first."""
    got = parts(url)
    if got is None:
        return "", [], []
    labels, steps = got
    h, size, ends, keys = digest(), 0, [], []
    for i, piece in enumerate([*[("." if j else "") + x for j, x in enumerate(labels)], *["/" + x for x in steps]]):
        h.update(piece.encode("utf-8", "surrogatepass"))
        size += len(piece)
        if i >= 1 or len(labels) == 1:
            ends.append(size)
            keys.append(h.intdigest())
    return ".".join(labels) + "".join("/" + x for x in steps), ends, keys


@dataclass
class Digests:
    """Ranges of keys (keys, offsets, strings), of memory or mapped files, and the least key of each but the first."""

    cuts: np.ndarray
    ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def arrays(keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return keys, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)

    @classmethod
    def of(cls, entries: Iterable[str | None], digest=xxhash.xxh64) -> Digests:
        texts = [t.encode() for t in sorted({entry(e) for e in entries} - {""})]
        keys = np.array([digest(t).intdigest() for t in texts], np.uint64)
        order = np.argsort(keys, kind="stable")
        return cls(np.zeros(0, np.uint64), [cls.arrays(keys[order], [texts[i] for i in order])])

    @classmethod
    def map(cls, cuts: np.ndarray, paths: list[str]) -> Digests:
        """Map the files if their folder is mounted; read them by the file system of their scheme if not."""
        ranges = []
        for path in paths:
            local = path.removeprefix("file://")
            if "://" not in local and os.path.isdir(os.path.dirname(local)):
                ranges.append(tuple(np.load(f"{local}.{n}.npy", mmap_mode="r") for n in ("keys", "offsets", "strings")))
            else:
                from pyarrow import fs

                files, base = fs.FileSystem.from_uri(path)
                ranges.append(tuple(np.load(io.BytesIO(files.open_input_stream(f"{base}.{n}.npy").read())) for n in ("keys", "offsets", "strings")))
        return cls(cuts, ranges)

    def match(self, probes: list[tuple[str, list[int], list[int]]]) -> list[str | None]:
        """The longest of each probe's prefixes that is an entry."""
        out: list[str | None] = [None] * len(probes)
        flat = np.array([k for _, _, keys in probes for k in keys], np.uint64)
        who = np.repeat(np.arange(len(probes)), [len(keys) for _, _, keys in probes])
        ends = [e for _, es, _ in probes for e in es]
        place = np.searchsorted(self.cuts, flat, "right")
        for r in np.unique(place):
            keys, offsets, strings = self.ranges[r]
            at = np.flatnonzero(place == r)
            lo, hi = np.searchsorted(keys, flat[at], "left"), np.searchsorted(keys, flat[at], "right")
            for j in np.flatnonzero(hi > lo):
                i, text = who[at[j]], probes[who[at[j]]][0][: ends[at[j]]]
                if len(text) > len(out[i] or "") and any(strings[offsets[k] : offsets[k + 1]].tobytes() == text.encode("utf-8", "surrogatepass") for k in range(lo[j], hi[j])):
                    out[i] = text
        return [None if x is None else shown(x) for x in out]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t for t in map(entry, b.column(0).to_pylist()) if t]
        keys = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), pa.array(texts, pa.string())], ["k", "entry"])


def _ranges(folder: str):
    """Write each task's sorted rows as one range; a task that is run again writes to another place, and only one is told of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        keys = t.column("k").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        for kind, array in zip(("keys", "offsets", "strings"), Digests.arrays(keys, [x.encode() for x in t.column("entry").to_pylist()])):
            data = io.BytesIO()
            np.save(data, array)
            with files.open_output_stream(f"{base}/{name}.{kind}.npy") as out:
                out.write(data.getbuffer())
        yield pa.RecordBatch.from_arrays([pa.array([str(keys[0])]), pa.array([f"{folder}/{name}"])], ["least", "path"])

    return run


def build(spark: SparkSession, blocklist: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[np.ndarray, list[str]]:
    """(the least key of each range but the first, the paths of all) of the sorted list below the shared folder."""
    keyed = shared.table(blocklist.select(F.col(blocklist.columns[0]).cast("string").alias("e")).mapInArrow(_entries, "k bigint, entry string").distinct(), "blocklist")
    n = max(1, -(-keyed.count() // range_rows))
    rows = keyed.repartitionByRange(n, "k") if n > 1 else keyed.repartition(1)  # equal keys stay in one range
    got = rows.sortWithinPartitions("k", "entry").mapInArrow(_ranges(shared.place(spark, "digests")), "least string, path string").collect()
    got = sorted((int(r["least"]), r["path"]) for r in got)
    return np.array([k for k, _ in got[1:]], np.uint64), [p for _, p in got]


_mapped: dict[str, Digests] = {}


def _filtered(cuts: np.ndarray, paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = paths[0] if paths else ""
        if key not in _mapped:
            _mapped.clear()
            _mapped[key] = Digests.map(cuts, paths) if paths else Digests.of([])
        for b in batches:
            hit = _mapped[key].match([candidates(u) for u in b.column("url").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array([h is not None for h in hit], pa.bool_()), pa.array(hit, pa.string())], ["id", "url", "blocked", "entry"])

    return run


def op8_urls(pages: DataFrame, blocklist: Iterable[str | None] | DataFrame = BLOCKLIST, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, blocked, entry) for every row of ``pages``.

    ``blocklist`` are entries, or a DataFrame whose first column has them; null, blank and
    malformed entries don't count. ``entry`` is the most specific one that blocks the URL,
    paths before hosts. Null, empty and malformed URLs, and those whose host is a number in
    brackets, aren't blocked; URLs of any length are probed in time linear in it; repeated rows are
    judged each; null ids are kept; other columns are ignored; an empty list blocks
    nothing, an empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(blocklist, DataFrame):
        blocklist = spark.createDataFrame([(e,) for e in blocklist], "entry string")
    cuts, paths = build(spark, blocklist)
    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(_filtered(cuts, paths), f"id {kind}, url string, blocked boolean, entry string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


_HOST = r"rtrim(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:\[\]\s]+)', 1), '.')"
_PATH = r"rtrim(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#\s]*)', 1), '/+', '/', 'g'), '/')"
ORACLE_SQL = (
    f"WITH h AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages) SELECT page_id, url, entry IS NOT NULL AS blocked, entry FROM (SELECT page_id, url, CASE "
    + " ".join(
        f"WHEN host || path = '{e}' OR starts_with(host || path, '{e}/') THEN '{e}'" if "/" in e else f"WHEN host = '{e}' OR host LIKE '%.{e}' THEN '{e}'"
        for e in sorted({shown(entry(x)) for x in BLOCKLIST} - {""}, key=lambda e: ("/" not in e, -len(e), e))
    )
    + " END AS entry FROM h) t"
)
