"""Main text of web pages: structure of the markup, and a suffix array per host for what is repeated across pages.

A page is read into blocks of text. Elements that are never article text (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments, scripts) are left out with all they hold. If a page marks its article, the blocks in that
container are its text, otherwise all blocks outside of what is left out.

What a host repeats is removed from both. The tokens of a page are one stream, that of its marked article another; the
suffixes of a host's streams are put into classes that agree on their first ``RUN`` tokens, which are the stretches of the
host's suffix array with common prefixes of at least that length. Only this depth matters: a longer repeated string is
covered by the classes of its windows. A class is boilerplate if it is found on ``PAGES`` pages and on ``SHARE`` of the
host's pages (in articles: of its pages with a marked article). Tokens not covered stay, in page order. Of near copies the
first page counts: pages that agree in ``ALIKE`` bands of min-hashes with the earliest page of these bands.

Tasks count the classes of their pages first and send them, packed, to the bucket of their key, so a host or a menu with a
third of all pages is aggregated where it is read. Classes of enough pages are sorted arrays that the workers map.

Text: character references decoded, white space inside a block one blank, blocks joined by a line feed.

Rows: null or empty markup gives an empty text; a null or strange address is a host of its own text; exact copies of a page do
not count as another page; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.llm.kneser_ney import _ROWS, Arrays, _batched, _by_buckets, _file, _read_rows, _rows, _summed, key_of
from voc.storage import materialize, scratch_path

RUN = 6                        # tokens that make a repeated string
PAGES, SHARE = 3, 0.5          # it is boilerplate on as many pages of a host, and on this share of them
BANDS, BAND_ROWS, ALIKE = 16, 4, 12   # near copies agree in ALIKE of 16 bands (about 0.93 of their words)
CHUNK = 2 << 20                # windows that a task counts before it sends
LOW = np.uint64(16)            # bits of a window's key that are not kept
COPY, REPEATED = 1, 2          # rows: near copy of an earlier page; occurs several times
ONCE, AGAIN = 0, 1
_MIX = np.random.default_rng(1).integers(1, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
NOISE_TAGS = frozenset("nav footer aside form head menu dialog button select datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination "
    "popup promo related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# a name of several parts counts by its last part, or by its first one in front of a word for a container
CONTAINERS = frozenset("area bar block bottom box container form inner item items left links list posts right section slot text top wrap wrapper".split())
STATES = frozenset("has hide is no not show with without".split())   # names that begin so tell a state, not what the element is
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
MAIN_WORDS = frozenset("article story entry-content post-content article-body main-content".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

NOISE, NEUTRAL, MAIN = 0, 1, 2


def _noise_word(name: str) -> str | None:
    """The noise word that a class or id stands for."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if not parts or parts[0] in STATES:
        return None
    if parts[-1] in NOISE_WORDS:
        return parts[-1]
    return parts[0] if parts[0] in NOISE_WORDS and parts[-1] in CONTAINERS else None


def _role(name: str, attributes: str, inside_main: bool) -> tuple[int | None, int | None, bool]:
    """(NOISE or MAIN if the element decides so, else None; the same without its names; a name says that it holds comments)."""
    found = {}
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    if name in NOISE_TAGS or (name == "header" and not inside_main):
        return NOISE, NOISE, False
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES:
        return NOISE, NOISE, False
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    mark = None
    if name in ("article", "main") or found.get("role") in ("main", "article") or (name in ("div", "section") and not MAIN_WORDS.isdisjoint(names)):
        mark = MAIN
    words = {_noise_word(n) for n in names} - {None} if name not in ("html", "body", "main") else ()
    return (NOISE if words else mark), mark, bool(words) and not COMMENT_WORDS.isdisjoint(words)


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """(text, role, in an article element) of every block in page order; NOISE blocks are kept for the host's statistics.

    A class or id with a noise word does not count for an element that is or holds the page's only article. If nothing but
    noise is left then, or the only article is one of comments and nothing stands beside it, names do not count at all.
    """
    out, holders, comments = _read(html, frozenset())
    roles = {role for _, role, _ in out}
    if MAIN not in roles and holders and (not comments or NEUTRAL not in roles):
        out, _, _ = _read(html, holders)
        roles = {role for _, role, _ in out}
    if roles == {NOISE}:
        out, _, _ = _read(html, None)
    return out


def _read(html: str, exempt: Set[int] | None) -> tuple[list[tuple[str, int, bool]], set[int], bool]:
    """(blocks, places of the elements that are noise by name only and are or hold an article, whether one of them holds comments).

    Names do not count for the elements at the places ``exempt``; None stands for all.
    """
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, tuple | None]] = []   # open elements, with the state inside them
    # named: the open elements that are noise by name, as a chain (place, comments, outer ones); None inside other noise
    role, article, named, at, tag = NEUTRAL, False, (), 0, TAG
    holders: set[int] = set()
    comments = False
    unclosed: Counter[str] = Counter()

    def close_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, role, article))
            parts.clear()

    while True:
        low = html.find("<", at)
        if low < 0:
            parts.append(html[at:])
            break
        parts.append(html[at:low])
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            if end < 0:
                break
            at = end + 3
            continue
        if html.startswith(("<!", "<?"), low):
            end = html.find(">", low)
            if end < 0:
                break
            at = end + 1
            continue
        m = tag.match(html, low)
        if m is None and html[low + 1 : low + 2].isalpha() or html.startswith("</", low) and m is None:
            # a quote that never ends: from here on tags end at the next bracket
            if tag is TAG and PLAIN_TAG.match(html, low):
                tag = PLAIN_TAG
                at = low
                continue
            if html.find(">", low) < 0:
                break                            # a tag that the page's end cuts off
            at = html.find(">", low) + 1
            continue
        if m is None:
            parts.append("<")
            at = low + 1
            continue
        at, name = m.end(), m[2].lower()
        if name == "br":
            parts.append(" ")
            continue
        if m[1]:
            if name in BLOCK:
                close_block()
            if unclosed[name]:
                popped = ""
                while popped != name:
                    popped = stack.pop()[0]
                    unclosed[popped] -= 1
                below = stack[-1][1:] if stack else (NEUTRAL, False, ())
                if below[:2] != (role, article):
                    close_block()
                role, article, named = below
            continue
        if name in BLOCK:
            close_block()
        if name in RAW:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            end = RAW_END[name].search(html, at)
            if end is None:
                break
            at = html.find(">", end.end())
            if at < 0:
                at = len(html)
                break
            at += 1
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            unclosed[stack.pop()[0]] -= 1        # these end where the next one of their kind begins
            role, article, named = stack[-1][1:] if stack else (NEUTRAL, False, ())
        own, mark, of_comments = _role(name, m[3], role == MAIN)
        if exempt is None or low in exempt:
            own = mark
        inner = named
        if named is not None and own == NOISE:
            inner = None if mark == NOISE else (low, of_comments, named)
        link = inner if mark == MAIN else ()
        while link and link[0] not in holders:
            holders.add(link[0])
            comments |= link[1]
            link = link[2]
        new = NOISE if role == NOISE or own == NOISE else (MAIN if role == MAIN or own == MAIN else NEUTRAL)
        inside = article or (new == MAIN and own == MAIN and name == "article")
        if new != role or inside != article:
            close_block()
        if name in BLOCK or new != role or inside != article or (stack and stack[-1][1] == NOISE):
            stack.append((name, new, inside, inner))
            unclosed[name] += 1
            role, article, named = new, inside, inner
    close_block()
    return out, holders, comments


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or (url or "")).lower()
    except ValueError:
        return url or ""


def main_blocks(found: list[tuple[str, int, bool]]) -> list[str] | None:
    """The blocks of the marked article; None if the page marks none."""
    if any(article for _, role, article in found if role == MAIN):
        return [text for text, role, article in found if role == MAIN and article]
    if any(role == MAIN for _, role, _ in found):
        return [text for text, role, _ in found if role == MAIN]
    return None


def suffixes(texts: list[str], run: int = RUN) -> np.ndarray:
    """For each position of the stream of all tokens, a hash of the ``run`` tokens from there; shorter streams have none."""
    tokens = [t for text in texts for t in text.split()]
    n = len(tokens) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t.encode()) for t in known), np.uint64, len(known))[at]
    return key_of([hashes[i : i + n] for i in range(run)])


def uncovered(texts: list[str], starts: np.ndarray, run: int = RUN) -> list[str]:
    """The texts without the tokens of repeated windows, given where these start in the stream of all tokens."""
    if not len(starts):
        return texts
    sizes = [len(t.split()) for t in texts]
    covered = np.zeros(sum(sizes) + run + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + run, -1)
    free, at, out = np.cumsum(covered) == 0, 0, []
    for text, size in zip(texts, sizes):
        out.append(" ".join(w for w, keep in zip(text.split(), free[at : at + size]) if keep))
        at += size
    return out


def bands(texts: list[str]) -> list[int]:
    """Hashes of ``BANDS`` groups of min-hashes of the texts' different words; none without words."""
    words = {w for t in texts for w in t.split()}
    if not words:
        return []
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(hashes), 4_096):
        mixed = (hashes[low : low + 4_096, None] * _MIX[0]) ^ _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * _MIX[0]).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k : k + BAND_ROWS].tobytes(), k) - 2**63 for k in range(0, BANDS * BAND_ROWS, BAND_ROWS)]


def _host_key(host: str, marked: bool) -> int:
    """A host's marked articles are a population of their own."""
    return xxhash.xxh64_intdigest(host.encode(), int(marked))


def _read_page(html: str | None) -> tuple[list[str], list[bool], list[str] | None]:
    """(blocks outside of articles, which of them are noise, the blocks of the marked article or None)."""
    found = blocks(html or "")
    rest = [(t, r == NOISE) for t, r, _ in found if r != MAIN]
    return [t for t, _ in rest], [n for _, n in rest], main_blocks(found)


def _signed64(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


_PARSED = (
    "_row bigint, page_id bigint, url string, host bigint, marked_host bigint, bands array<int>, texts array<string>, "
    "noise array<boolean>, main array<string>"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page parsed: its blocks, the host keys as they name the two populations, and the bands of its own text."""
    for batch in batches:
        rows = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
            texts, noise, main = _read_page(html.as_py())
            own = [t for t, n in zip(texts, noise) if not n] if main is None else main
            host = host_of(url)
            # half of a band's hash is enough: several bands have to agree
            half = [b >> 32 for b in bands(own)]
            rows.append((_host_key(host, False), None if main is None else _host_key(host, True), half, texts, noise, main))
        hosts, marked, found, texts, noise, main = zip(*rows) if rows else ((),) * 6
        strings = pa.list_(pa.string())
        yield pa.record_batch(
            [
                *(batch.column(c) for c in ("_row", "page_id", "url")), _signed64(hosts),
                pa.array([None if m is None else m - (m >> 63 << 64) for m in marked], pa.int64()), pa.array(found, pa.list_(pa.int32())),
                pa.array(texts, strings), pa.array(noise, pa.list_(pa.bool_())), pa.array(main, strings),
            ],
            names=["_row", "page_id", "url", "host", "marked_host", "bands", "texts", "noise", "main"],
        )


def _unsigned(column: pa.Array) -> list[int | None]:
    return [None if x is None else x & (1 << 64) - 1 for x in column.to_pylist()]


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, the bytes of equal weight together."""
    steps = np.diff(keys >> LOW, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(len(keys).to_bytes(8, "little") + planes.tobytes() + counts.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)
    return np.cumsum(steps, dtype=np.uint64) << LOW, np.frombuffer(data, "<u4", n, 8 + 8 * n)


def _keys(windows: np.ndarray, host: int) -> np.ndarray:
    """Keys of a host's windows; 48 bits are kept."""
    return (key_of([windows, np.full(len(windows), host, np.uint64)]) >> LOW) << LOW


def _count(bits: int, rows: Arrays):
    """Counts the windows of pages, once a page, and sends them to the buckets of their keys.

    Of near copies the first page counts. Rows that occur several times are sent with their numbers.
    """

    def sent(kind: int, keys: np.ndarray, pack) -> Iterator[tuple[int, int, bytes]]:
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.append(True, np.diff(bucket) > 0)).tolist() if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            yield kind, int(bucket[a]), pack(a, b)

    def counted(held: list[np.ndarray], again: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, int, bytes]]:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        yield from sent(ONCE, keys, lambda a, b: _packed(keys[a:b], counts[a:b]))
        pairs = np.concatenate([np.zeros((0, 2), np.uint64), *(np.stack([k, np.full(len(k), row, np.uint64)], 1) for k, row in again)])
        pairs = np.unique(pairs, axis=0)
        yield from sent(AGAIN, pairs[:, 0], lambda a, b: zstandard.compress(np.ascontiguousarray(pairs[a:b]).tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again, size = [], [], 0
        for batch in batches:
            names = batch.column("_row").to_numpy().view(np.uint64)
            (states,) = rows.find(names, 1)
            hosts, marked = _unsigned(batch.column("host")), _unsigned(batch.column("marked_host"))
            for i, (row, state) in enumerate(zip(names.tolist(), states.tolist())):
                if state == COPY:
                    continue
                for name, host in (("texts", hosts[i]), ("main", marked[i])):
                    if host is None:
                        continue
                    keys = np.unique(_keys(suffixes(batch.column(name)[i].as_py()), host))
                    again.append((keys, row)) if state == REPEATED else held.append(keys)
                    size += len(keys)
                if size > CHUNK:
                    yield from _batched(counted(held, again))
                    held, again, size = [], [], 0
        if size:
            yield from _batched(counted(held, again))

    return run


def _merge(folder: str):
    """Writes the windows of at least ``PAGES`` pages of a bucket as sorted arrays."""

    def merged(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        found = [_unpacked(p) for kind, p in parts if kind == ONCE]
        pairs = [np.frombuffer(zstandard.decompress(p), np.uint64).reshape(-1, 2) for kind, p in parts if kind == AGAIN]
        twice = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *pairs]), axis=0)[:, 0]
        keys = np.concatenate([*(k for k, _ in found), twice])
        counts = np.concatenate([*(c for _, c in found), np.ones(len(twice), np.uint32)])
        keys, (counts,), _ = _summed(keys, [counts])
        often = counts >= PAGES
        yield _file(folder, "windows", bucket, [keys[often], counts[often].astype("<u8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(row for bucket, parts in _by_buckets(batches) for row in merged(bucket, parts))

    return run


def _stored(rows: DataFrame, name: str, bits: int) -> Arrays:
    """Sorted arrays of the columns ``key, value`` (bigint, different keys) in the shared folder."""
    folder = scratch_path(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column(0)[0].as_py()
                keys.append(batch.column(1).to_numpy())
                values.append(batch.column(2).to_numpy())
        found, kept = np.concatenate(keys).view(np.uint64), np.concatenate(values)
        if len(found):
            order = np.argsort(found)
            yield _rows([_file(folder, name, bucket, [found[order], kept[order]])])

    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = rows.select(bucket.alias("bucket"), "key", "value").repartitionById(1 << bits, F.col("bucket"))
    return _read_rows(materialize(dealt.mapInArrow(run, _ROWS), name), bits)[0]


def _finish(hosts: Arrays, windows: Arrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part, pages = batch.slice(low, 500), []
                read = zip(*(part.column(c).to_pylist() for c in ("texts", "noise", "main")), _unsigned(part.column("host")), _unsigned(part.column("marked_host")))
                for texts, noise, main, host, marked in read:
                    if main is not None:
                        texts, noise, host = main, [False] * len(main), marked
                    pages.append((texts, noise, host, _keys(suffixes(texts), host)))
                sizes = [len(keys) for *_, keys in pages]
                some, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys for *_, keys in pages)]), return_inverse=True)
                (counts,) = windows.find(some, 1)
                (of_host,) = hosts.find(np.array([host for _, _, host, _ in pages], np.uint64), 1)
                often, out, edge = counts[at], [], 0
                for (texts, noise, _, _), size, n in zip(pages, sizes, of_host.tolist()):
                    starts = np.flatnonzero(often[edge : edge + size] >= max(PAGES, SHARE * n))
                    edge += size
                    out.append("\n".join(t for t, skip in zip(uncovered(texts, starts), noise) if t and not skip))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    spark = pages.sparkSession
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    # equal rows have equal numbers, so the passes below agree on them whatever the order of rows
    rows = pages.select(F.xxhash64("page_id", "url", F.isnull("url"), "html").alias("_row"), "page_id", "url", "html")
    # parsed once and written, well packed since it is the pages' text; the passes below read blocks
    path = scratch_path(spark, "pages")
    rows.mapInArrow(_parsed, _PARSED).write.option("compression", "zstd").parquet(path)
    signed = spark.read.schema(_PARSED).parquet(path)
    banded = signed.select("host", "_row", F.posexplode("bands").alias("band", "key"))
    least = banded.groupBy("host", "band", "key").agg(F.min("_row").alias("first"), F.max("_row").alias("last"))
    met = banded.join(least.filter("first != last").drop("last"), ["host", "band", "key"]).filter("_row != first")
    copies = met.distinct().groupBy("_row", "first").count().filter(F.col("count") >= ALIKE).select("_row").distinct()
    copies = materialize(copies, "copies")
    counted = signed.groupBy("_row").agg(F.first("host").alias("host"), F.first("marked_host").alias("marked_host"), F.count("*").alias("n"))
    counted = counted.join(copies.withColumn("copy", F.lit(True)), "_row", "left")
    state = F.when(F.col("copy"), COPY).when(F.col("n") > 1, REPEATED)
    states = _stored(counted.select(F.col("_row").alias("key"), state.cast("bigint").alias("value")).filter("value is not null"), "rows", bits)
    single = counted.filter("copy is null")
    both = single.select(F.col("host").alias("key")).unionByName(single.filter("marked_host is not null").select(F.col("marked_host").alias("key")))
    hosts = _stored(both.groupBy("key").agg(F.count("*").alias("value")), "hosts", bits)
    sent = signed.select("_row", "host", "marked_host", "texts", "main").mapInArrow(_count(bits, states), _ROWS)
    folder = scratch_path(spark, "windows")
    stored = sent.repartitionById(1 << bits, F.col("bucket")).mapInArrow(_merge(folder), _ROWS)
    windows, _ = _read_rows(materialize(stored, "window_files"), bits)
    out = signed.drop("_row", "bands").mapInArrow(_finish(hosts, windows), "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
