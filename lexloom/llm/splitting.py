"""Problem 2: cutting oversized items at natural boundaries.

A text (a row's value or a file of any size) is processed as ranges.  A range is
read with a halo after it, and its natural start found in its own halo: the best
boundary (stanza, line, sentence, word, else the bare offset) within the first
``limit`` units.  The start of the next range is found by the same rule from the
halo, so neighbouring workers agree without talking.  A boundary table with one
row per range (start, code points, line ends, and the segments left open at both
ends) is stitched by prefix sums, and a second pass emits the pieces of every
range by global offset.  The ranges of a row are measured and stitched where the
row is; those of a file by as many workers as it has ranges, none of which holds
a whole file.

Inside a range the text is divided at stanzas; what is over the limit at lines;
then at sentences, at words, and last at the bare limit.  Neighbouring segments
are joined again while they fit, preferring to end at a coarser boundary.

Defined results: null and blank texts give no piece; a text within the limit is
one piece of its trimmed self (``split`` keeps only oversized ones unless told
otherwise); repeated rows count once; where an id has several texts each is cut;
an empty table gives no rows; only the named columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import Cut, read, spread

LIMIT, OVERLAP = 1200, 120
RANGE = 4096  #: code points of a text column in a range, at least the limit
FILE_RANGE = 4 << 20  #: bytes of a file in a range
KINDS = ("stanza", "line", "sentence", "word", "none")
BLANK = " \t\r\n"
_CUTS = [
    re.compile(r"(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+"),
    re.compile(r"[\r\n]+"),
    re.compile(r"(?<=[.?!])[ \t\r\n]+"),
    re.compile(r"[ \t\r\n]+"),
]


def _trim(t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and t[a] in BLANK:
        a += 1
    while b > a and t[b - 1] in BLANK:
        b -= 1
    return a, b


def _divide(t: str, a: int, b: int, kind: int, limit: int, out: list[tuple[int, int, int]]) -> None:
    """Segments of t[a:b], each with the kind of the boundary before it, all within the limit."""
    a, b = _trim(t, a, b)
    if b <= a:
        return
    if b - a <= limit:
        out.append((a, b, kind))
        return
    for k in range(kind, 4):
        cuts = [m.end() for m in _CUTS[k].finditer(t, a, b)]
        if cuts:
            first = True
            for x, y in zip([a, *cuts], [*cuts, b]):
                n = len(out)
                _divide(t, x, y, k, limit, out)
                if first and len(out) > n:
                    out[n] = (*out[n][:2], kind)  # the boundary before the first is the parent's
                first = first and len(out) == n
            return
    for x in range(a, b, limit):
        out.append((x, min(b, x + limit), kind if x == a else 4))


def coarsest(t: str, limit: int = LIMIT) -> str | None:
    """The first kind of boundary at which no segment stays over the limit; null if the text fits."""
    a, b = _trim(t, 0, len(t))
    if b - a <= limit:
        return None
    spans = [(a, b)]
    for k, cut in enumerate(_CUTS):
        new = []
        for x, y in spans:
            ends = [m.end() for m in cut.finditer(t, x, y)]
            new += [_trim(t, p, q) for p, q in zip([x, *ends], [*ends, y])]
        spans = [(p, q) for p, q in new if q - p > limit]
        if not spans:
            return KINDS[k]
    return "none"


def _ends(t: str) -> int:
    return len(re.findall(r"\r\n|\r|\n", t))


_RANGE = "first long, last long, lead int, trail int, feed boolean, ret boolean, stop boolean, head array<long>, tail array<long>, inner array<long>"


def _open(t: str, at: int, limit: int) -> tuple:
    """What a range's own text at offset ``at`` tells of the segments that run over its ends.

    Offsets of its first and past its last sign, line ends before and after them,
    whether it starts with LF and ends with CR, whether the last sign ends a
    sentence; by kind the end of the first segment, the start of the last, and the
    longest of the others (right as far as it is over the limit).
    """
    a, b = _trim(t, 0, len(t))
    feed, ret = t[:1] == "\n", t[-1:] == "\r"
    if b <= a:
        return None, None, _ends(t), 0, feed, ret, False, [], [], []
    head, tail, inner, spans = [], [], [], [(a, b)]
    for cut in _CUTS:
        new = []
        for x, y in spans:
            ends = [m.end() for m in cut.finditer(t, x, y)]
            new += [_trim(t, p, q) for p, q in zip([x, *ends], [*ends, y])]
        head.append(at + new[0][1])
        tail.append(at + new[-1][0])
        inner.append(max((q - p for p, q in new[1:-1]), default=0))
        spans = [s for i, s in enumerate(new) if i in (0, len(new) - 1) or s[1] - s[0] > limit]
    return at + a, at + b, _ends(t[:a]), _ends(t[b:]), feed, ret, t[b - 1] in ".?!", head, tail, inner


def _stitch(ranges: list[tuple], limit: int) -> int:
    """``coarsest`` of a whole text from its ranges in order, as an index of KINDS; -1 if the text fits."""
    longest, start = [0] * 4, [0] * 4
    begin = end = None
    lines, ret, stop = 0, False, False  # of the blanks since the last sign, and the sign
    for first, last, lead, trail, feed, cr, full, head, tail, inner in ranges:
        lines += lead - (ret and feed)  # a CR LF across the ranges is one line end
        if first is None:
            ret = cr if lead or feed else False
            continue
        if end is None:
            begin, start = first, [first] * 4
        elif first > end:
            kind = 0 if lines > 1 else 1 if lines else 2 if stop else 3
            for k in range(kind, 4):
                longest[k], start[k] = max(longest[k], end - start[k]), first
        for k in range(4):
            if tail[k] != first:
                longest[k], start[k] = max(longest[k], head[k] - start[k], inner[k]), tail[k]
        end, lines, ret, stop = last, trail, cr, full
    if end is None or end - begin <= limit:
        return -1
    return next((k for k in range(4) if max(longest[k], end - start[k]) <= limit), 4)


def _back(t: str, start: int, end: int, overlap: int) -> int:
    """Where the repeated part of a piece t[start:end] begins: after white space if there is any in reach."""
    low = max(start, end - overlap)
    if low > start:
        m = re.compile(r"\s").search(t, low, end)
        if not t[low - 1].isspace() and m and m.end() < end:
            return m.end()
    return low


def cut_text(t: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start of the repeated text, start, end, kind of the boundary at the start) of every piece.

    The repeated text is at most ``overlap`` code points from the end of the
    piece before; it begins after white space where there is any in reach.
    """
    seg: list[tuple[int, int, int]] = []
    _divide(t, 0, len(t), 0, limit, seg)
    out: list[tuple[int, int, int, int]] = []
    i = 0
    while i < len(seg):
        a, j = seg[i][0], i
        while j + 1 < len(seg) and seg[j + 1][1] - a <= limit:
            j += 1
        if j + 1 < len(seg):  # full: end at the coarsest boundary of the second half, the last of its kind
            ends = [(seg[k + 1][2], -k, k) for k in range(i, j + 1) if seg[k][1] - a >= limit // 2]
            j = min(ends)[2] if ends else j
        b, back = seg[j][1], a
        if out:
            back = _back(t, out[-1][1], out[-1][2], overlap)
        out.append((back, a, b, seg[i][2]))
        i = j + 1
    return out


def _start(t: str, limit: int) -> int:
    """Where a range begins in its own text: after the best boundary of its first ``limit`` units."""
    for cut in _CUTS:
        m = cut.search(t, 0, limit)
        if m:
            return m.end()
    return 0


_PIECES = "piece_start long, piece_end long, new_start long, boundary string, first_line long, last_line long, text string"


def split(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), limit: int = LIMIT, overlap: int = OVERLAP, every: bool = False, size: int = RANGE) -> DataFrame:
    """Pieces of the oversized texts of a column: ``id, carry..., needs, piece, piece_start, piece_end, new_start, boundary, first_line, last_line, text``.

    ``needs`` is the first kind of boundary that suffices for the whole unit;
    offsets are code points of the text, ``text`` is t[piece_start:piece_end],
    of which t[piece_start:new_start] repeats the piece before.
    """
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[F.col(c).alias(f"carry_{c}") for c in carry]).where("t is not null")
    core = F.regexp_replace("t", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    x = x.where(F.length(core) > (0 if every else limit)).distinct()
    kept = ["id", *[f"carry_{c}" for c in carry]]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            where: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(pdf["t"]):
                for row in emit(t, limit, overlap, size):
                    where.append(i)
                    rows.append(row)
            out = pdf[kept].iloc[where].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=_COLUMNS)], axis=1)

    kinds = dict(x.dtypes)
    p = x.mapInPandas(pieces, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", needs string, " + _PIECES)
    return p.select(F.col("id").alias(id_col), *[F.col(f"carry_{c}").alias(c) for c in carry], *p.columns[len(kept) :])


_COLUMNS = ["needs", "piece_start", "piece_end", "new_start", "boundary", "first_line", "last_line", "text"]


def emit(t: str, limit: int, overlap: int, size: int) -> Iterator[tuple]:
    """The pieces of a text from its ranges, as rows of _COLUMNS: starts from the halos, the boundary table stitched, pieces by offset."""
    if size < limit:
        raise ValueError("a range must hold a piece")
    starts = [at + (_start(t[at : at + limit], limit) if at else 0) for at in range(0, max(1, len(t)), size)]
    ends = [*starts[1:], len(t)]
    table = [_open(t[a:b], a, limit) for a, b in zip(starts, ends)]
    need = _stitch(table, limit)
    kind = KINDS[need] if need >= 0 else None
    line, last = 1, None
    for a, b in zip(starts, ends):
        own, at = t[a:b], 0
        for n, (back, x, y, k) in enumerate(cut_text(own, limit, overlap)):
            line += own.count("\n", at, x)
            at = x
            first = a + back if n or last is None else _back(t, *last, overlap)  # the piece before may end in the range before
            last = a + x, a + y
            yield kind, first, a + y, a + x, KINDS[k] if a + x and n + a else "start", line, line + own.count("\n", x, y), t[first : a + y]
        line += own.count("\n", at)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of UTF-8 files by byte range: ``path, piece_start, piece_end, new_start, char_start, first_line, boundary, text``.

    Offsets are bytes, limit and overlap code points; ``char_start`` and
    ``first_line`` come from the prefix sums of the ranges before.  Paths are
    those of any file system that Spark and Arrow both know; each task reads only
    its range and halo.
    """
    halo = 8 * limit
    if paths:  # only the names and lengths are read here
        found = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("total"))
    else:
        found = spark.createDataFrame([], "path string, total long")
    cuts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))
    r = found.where("total > 0").select("path", "total", F.posexplode(cuts).alias("range", "at")).select("path", F.col("range").cast("long").alias("range"), "at", "total")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartition(tasks, "path", "range")

    def load(path: str, at: int) -> tuple[str, str, int]:
        """The range's text from its first whole character, what stands before it, and bytes skipped."""
        from pyarrow import fs

        where, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
        with where.open_input_file(name) as f:
            low = max(0, at - 4 * overlap)
            f.seek(low)
            b = f.read(at - low + size + halo)
        head, body = b[: at - low], b[at - low :]
        skip = 0
        while skip < len(body) and at and body[skip] & 0xC0 == 0x80:
            skip += 1
        return body[skip:].decode("utf-8", "replace"), (head + body[:skip]).decode("utf-8", "ignore")[-overlap:], skip

    def own(t: str, at: int, total: int, skip: int) -> tuple[int, int]:
        a = _start(t, limit) if at else 0
        if at + size >= total:
            return a, len(t)
        raw = t.encode()[size - skip :]
        k = 0
        while k < len(raw) and raw[k] & 0xC0 == 0x80:
            k += 1
        rest = raw[k:].decode("utf-8", "replace")
        return a, len(t) - len(rest) + _start(rest, limit)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, k, at, total in pdf.itertuples(index=False):
                t, _, skip = load(p, at)
                a, b = own(t, at, total, skip)
                rows.append((p, k, at, total, b - a, t.count("\n", a, b)))
            yield pd.DataFrame(rows, columns=["path", "range", "at", "total", "chars", "lines"])

    table = Cut(r.mapInPandas(measure, "path string, range long, at long, total long, chars long, lines long"), "ranges").df
    w = Window.partitionBy("path").orderBy("range")
    stitched = table.select("path", "at", "total", (F.sum("chars").over(w) - F.col("chars")).alias("char0"), (F.sum("lines").over(w) - F.col("lines")).alias("line0"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, at, total, char0, line0 in pdf.itertuples(index=False):
                t, before, skip = load(p, at)
                a, b = own(t, at, total, skip)
                rows = []
                base, pos = at + skip + len(t[:a].encode()), 0
                for n, (back, x, y, k) in enumerate(cut_text(t[a:b], limit, overlap)):
                    x, y = x + a, y + a
                    base += len(t[a + pos : x].encode())
                    pos = x - a
                    held = (before + t[:x]).rstrip(BLANK)[-overlap:] if n == 0 and at else t[back + a : x].rstrip(BLANK) if n else ""
                    rows.append((p, base - len(held.encode()), base + len(t[x:y].encode()), base, char0 + x - a, line0 + 1 + t.count("\n", a, x), KINDS[k] if n or at else "start", held + t[x:y] if n == 0 else t[back + a : y]))
                yield pd.DataFrame(rows, columns=["path", "piece_start", "piece_end", "new_start", "char_start", "first_line", "boundary", "text"])

    return stitched.repartition(tasks, "path", "at").mapInPandas(emit, "path string, piece_start long, piece_end long, new_start long, char_start long, first_line long, boundary string, text string")


def line_span(line_range: Column | str) -> tuple[Column, Column]:
    """First and last line of a well-formed ``a-b`` with a <= b, else nulls."""
    c = F.col(line_range) if isinstance(line_range, str) else line_range
    a, b = (F.expr(f"try_cast({x} as bigint)") for x in ("regexp_extract(line_range, '^ *([0-9]{1,9}) *[-–] *([0-9]{1,9}) *$', 1)", "regexp_extract(line_range, '^ *([0-9]{1,9}) *[-–] *([0-9]{1,9}) *$', 2)"))
    ok = c.isNotNull() & (a <= b)
    return F.when(ok, a), F.when(ok, b)


def _pieces(spark, sf_dir: str, size: int = RANGE) -> DataFrame:
    return split(spread(read(spark, sf_dir, "chunks")), "chunk_id", "original_text", ("stanza_number", "line_range"), size=size)


def p2_ranges(spark, sf_dir: str) -> DataFrame:
    """The same as p2_found from the smallest ranges there can be: where a text is cut into ranges must not matter."""
    return _pieces(spark, sf_dir, LIMIT).select("chunk_id", F.col("needs").alias("boundary")).distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("chunk_id", F.col("needs").alias("boundary")).distinct()


def p2_pieces(spark, sf_dir: str) -> DataFrame:
    """Every piece with the unit's stanza number and its own lines of the unit's line range."""
    a, b = line_span("line_range")
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("new_start", "text")).alias("piece")
    first = F.least(a + F.col("first_line") - 1, b)
    last = F.least(a + F.col("last_line") - 1, b)
    return _pieces(spark, sf_dir).select("chunk_id", n, "stanza_number", "line_range", first.alias("line_from"), last.alias("line_to"), "boundary", "piece_start", "new_start", "piece_end", "text")


def p2_cover(spark, sf_dir: str) -> DataFrame:
    """What must hold of a unit's pieces: together they are its text, none is over the limit, none repeats more than it may."""
    x = _pieces(spark, sf_dir).withColumn("own", F.expr("substring(text, int(new_start - piece_start + 1))"))
    by = x.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("new_start", "own"))).alias("p"), F.max(F.length("own")).alias("most"), F.max(F.col("new_start") - F.col("piece_start")).alias("more"))
    whole = F.regexp_replace(F.array_join(F.transform("p", lambda z: z["own"]), ""), r"[ \t\r\n]+", "")
    gap = F.transform("p", lambda z: z["new_start"])
    return by.select("chunk_id", F.md5(whole.cast("binary")).alias("content"), (F.col("most") <= LIMIT).alias("fits"), (F.col("more") <= OVERLAP + LIMIT).alias("bounded"), (F.size(gap) == F.size(F.array_distinct(gap))).alias("once"))


_LONGEST = "list_max(list_transform({0}, lambda x: length(regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))))"
SQL = {
    # a CR LF becomes LF and a blank: as long, and one line end
    "p2_found": f"""
with t as (select distinct chunk_id, replace(original_text, chr(13) || chr(10), chr(10) || ' ') t from chunks),
m as (select chunk_id, {_LONGEST.format('[t]')} a, {_LONGEST.format("regexp_split_to_array(t, '[\\r\\n](?:[ \\t]*[\\r\\n])+')")} b, {_LONGEST.format("regexp_split_to_array(t, '[\\r\\n]+')")} c,
  {_LONGEST.format("regexp_split_to_array(regexp_replace(t, '([.?!])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')")} d, {_LONGEST.format("regexp_split_to_array(t, '[ \\t\\r\\n]+')")} e from t)
select chunk_id, case when b <= {LIMIT} then 'stanza' when c <= {LIMIT} then 'line' when d <= {LIMIT} then 'sentence' when e <= {LIMIT} then 'word' else 'none' end as boundary from m where a > {LIMIT}
"""
}
SQL["p2_ranges"] = SQL["p2_found"]
SQL["p2_cover"] = f"""select chunk_id, md5(regexp_replace(t, '[ \\t\\r\\n]+', '', 'g')) as content, true as fits, true as bounded, true as once
from (select distinct chunk_id, original_text t from chunks) where length(regexp_replace(t, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) > {LIMIT}"""
QUERIES = {"p2_cover": p2_cover, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_ranges": p2_ranges}
