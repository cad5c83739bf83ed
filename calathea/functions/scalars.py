"""Scalar derivations of catalogued assets, as Column expressions.

Each returns null where an input it needs is null, unless its docstring says otherwise. Rounding that must be
half-even uses ``bround``; parsing that may fail uses ``try_`` functions, as ANSI casts raise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, EARTH_KM_ROUND = 6371.0088, 6371.0


def extension(path: Column) -> Column:
    """Text after the last dot, upper case; empty without a dot."""
    return F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    """The name without its last extension, lower case."""
    return F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))


def live_base(name: Column) -> Column:
    """Stem without the suffix that motion clips carry."""
    return F.regexp_replace(stem(name), "_hevc$", "")


def nearest_second(ts: Column) -> Column:
    """Whole seconds since 1970 of a time, rounded; half seconds to the even one, as a cast of them does in SQL."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def strip_collision(name: Column, size: Column) -> Column:
    """Drop a trailing -<digits> of the stem if the digits are the file's own size."""
    digits = F.regexp_extract(name, r"^(.*)-(\d+)(\.[^.]+)$", 2)
    return F.when(digits == size.cast("string"), F.regexp_replace(name, r"-\d+(\.[^.]+)$", "$1")).otherwise(name)


def path_year(path: Column) -> Column:
    """The first path segment that is a year from 1900 to 2100."""
    found = F.filter(F.split(path, "/"), lambda s: s.rlike("^[0-9]{4}$") & F.try_to_number(s, F.lit("9999")).between(1900, 2100))
    return F.get(found, F.lit(0)).cast("int")


def path_month(path: Column) -> Column:
    """The two-digit segment right after the year."""
    parts = F.split(path, "/")
    month = F.get(parts, F.array_position(parts, path_year(path).cast("string")).cast("int"))
    return F.when(month.rlike("^[0-9]{2}$"), month.cast("int"))


def shared_flag(name: Column) -> Column:
    """Case-sensitive marks of shared items in a file name."""
    return name.startswith("od_") | name.contains("_singular_display")


def number_or_null(text: Column) -> Column:
    return F.when(F.trim(text) == "", None).otherwise(text).try_cast("double")


def camera_epoch(text: Column) -> Column:
    """Epoch seconds of "YYYY:MM:DD HH:MM:SS[+hh:mm]"; naive means UTC; zero dates are null."""
    p = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}:\d{2}:\d{2})(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    part = lambda k: F.regexp_extract(text, p, k)
    plain = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), F.concat(part(3), F.lit(" "), part(4))), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_replace(part(5), ":", "")
    shift = F.when(zone.rlike(r"^[+-]\d{4}$"), (zone.substr(2, 2).cast("int") * 3600 + zone.substr(4, 2).cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.when(part(1).isin("", "0000"), None).otherwise(F.unix_timestamp(plain) - shift)


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO time, whatever the session's zone; naive means UTC, a date alone its midnight."""
    t = F.trim(text)
    zoned = t.rlike(r"(?:[Zz]|[0-9]{2}[+-][0-9]{2}:?[0-9]{0,2})$") & t.rlike("[0-9]:[0-9]")
    whole = F.when(zoned, t).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_timestamp(F.try_to_timestamp(whole))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def effective_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """(width, height) as shown: orientations 5 to 8 swap them."""
    turned = orientation.isin(5, 6, 7, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def aspect(width: Column, height: Column, orientation: Column) -> Column:
    w, h = effective_size(width, height, orientation)
    return F.bround(F.try_divide(w, h), 4)


def is_portrait(width: Column, height: Column, orientation: Column) -> Column:
    w, h = effective_size(width, height, orientation)
    return h > w


def bucket(year: Column, month: Column) -> Column:
    """YYYY-MM, YYYY-00 without a month, "undated" without a year."""
    return F.when(year.isNull(), "undated").otherwise(F.format_string("%04d-%02d", year.cast("int"), F.coalesce(month, F.lit(0)).cast("int")))


def day_of_bucket(ts: Column, year: Column, month: Column) -> Column:
    """Day of the month if the time agrees with year and month, else 0."""
    return F.when((F.year(ts) == year) & (F.month(ts) == month), F.dayofmonth(ts)).otherwise(0)


def week_of_day(day: Column) -> Column:
    """Weeks 0 to 4 of a month by sevens; 9 for day 0."""
    return F.when(day == 0, 9).otherwise(F.least(F.lit(4), F.floor((day - 1) / 7))).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM, clamp: bool = True) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    root = F.sqrt(a)
    return 2 * radius * F.asin(F.least(F.lit(1.0), root) if clamp else root)


def grid_cell(coordinate: Column, metres: float) -> Column:
    """Number of the cell, half-even, of a grid in degrees of about that size."""
    return F.bround(coordinate / F.lit(metres / 111320.0)).cast("long")


def coordinate_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2f°%s %.2f°%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def place_title(city: Column, state: Column, country: Column, states: Mapping[str, str]) -> Column:
    """City and the state's abbreviation if it has one, else city and country."""
    short = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))[state] if states else F.lit(None).cast("string")
    return F.concat_ws(", ", city, F.coalesce(short, country))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits, 64 if one cannot be parsed; by halves, as 64 bits overflow."""
    half = lambda x, at: F.conv(x.substr(at, 8), 16, 10).cast("long")
    fine = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in (1, 9)), F.lit(0))
    return F.when(F.coalesce(fine, F.lit(False)), bits).otherwise(64).cast("int")


def false_positive(centre: Column, whole: Column, bar: float = 93.6, ratio: float = 2.0) -> Column:
    """Whether the centre is sharp enough, against the whole, for a blurry verdict to be doubtful."""
    return (centre >= bar) & (centre >= ratio * whole)


def partial_digest(content: Column, edge: int = 1 << 20) -> Column:
    """Digest of the first and the last bytes of a content."""
    return F.sha2(F.concat(F.substring(content, 1, edge), F.when(F.length(content) > edge, content.substr(F.greatest(F.lit(edge + 1), F.length(content) - edge + 1), F.lit(edge))).otherwise(F.lit(b""))), 256)


def l2_normalise(vector: Column) -> Column:
    """The vector at length one; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unescape(text: Column) -> Column:
    """Character references resolved, in one pass: &#65; &#x41; and the named ones of HTML 4, each with its semicolon."""
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
    names = F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def resolved(e: Column) -> Column:
        name = e.substr(F.lit(2), F.length(e) - 2)
        digits = F.when(name.rlike("^#[xX]"), F.conv(name.substr(F.lit(3), F.length(name)), 16, 10)).otherwise(name.substr(F.lit(2), F.length(name)))
        code = digits.try_cast("int")
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        of_code = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(name.startswith("#"), of_code).otherwise(names[name]), e)

    gaps = F.split(text, pattern, -1)
    woven = F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(found), resolved(F.get(found, i))).otherwise("")))
    return F.when(text.contains("&"), F.array_join(woven, "")).otherwise(text)


def canonical_text(text: Column) -> Column:
    """Character references resolved, underscores to spaces, ASCII punctuation away, lower case, single spaces, trimmed."""
    bare = F.regexp_replace(F.translate(unescape(text), "_", " "), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]""", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def prompt_pair(vector: Column, good: Column, bad: Column, temperature: float = 0.05) -> Column:
    """How much nearer a vector is to one prompt's vector than to the other's: the softmax of both dot products."""
    return softmax2(dot(vector, good), dot(vector, bad), temperature)


def softmax2(a: Column, b: Column, temperature: float = 0.05) -> Column:
    """Share of a in the softmax of two scores."""
    top = F.greatest(a, b)
    return F.exp((a - top) / temperature) / (F.exp((a - top) / temperature) + F.exp((b - top) / temperature))


def badge(score: Column, good: float = 0.6, bad: float = 0.25) -> Column:
    return F.when(score >= good, "good").when(score <= bad, "bad").when(score.isNotNull(), "mid")


def decile(score: Column) -> Column:
    """0 to 9 of a score in [0, 1]."""
    return F.least(F.greatest(F.floor(score * 10), F.lit(0)), F.lit(9)).cast("int")


def time_of_day(hour: Column) -> Column:
    """night to 5, morning to 11, afternoon to 17, evening to 23."""
    return F.when(hour <= 5, "night").when(hour <= 11, "morning").when(hour <= 17, "afternoon").when(hour.isNotNull(), "evening")


def banded(value: Column, edges: Sequence[tuple[float, str]], last: str, missing: str) -> Column:
    """The label of the first edge that the value is below."""
    out = F.when(value.isNull(), missing)
    for edge, label in edges:
        out = out.when(value < edge, label)
    return out.otherwise(last)


def duration_bucket(seconds: Column) -> Column:
    return banded(F.when(seconds >= 0, seconds), [(60, "<1min"), (300, "1-5min"), (1200, "5-20min")], ">20min", "no-dur")


def size_band(size: Column) -> Column:
    mb = size / 1e6
    return F.when(mb >= 20, "A_>20MB").when(mb >= 5, "B_5-20MB").when(mb >= 1, "C_1-5MB").when(mb.isNotNull(), "D_<1MB")


def json_object(text: Column) -> Column:
    """The first object of a text with words around it: from the first brace to the one that closes it; null without."""
    start = F.instr(text, "{")
    chars = F.split(F.when(start > 0, text.substr(start, F.length(text))), "")
    step = lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    # the state is depth and, once it is 0 again, the length so far
    state = F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed")), lambda a, c: F.when(a["closed"], a).otherwise(
        F.struct((a["depth"] + step(c)).alias("depth"), (a["n"] + F.length(c)).alias("n"), ((c == "}") & (a["depth"] == 1)).alias("closed"))))
    return F.when(state["closed"], text.substr(start, state["n"]))


def repaired_array(items: Column) -> Column:
    """Comma-joined elements split, trimmed, empty and null ones dropped."""
    return F.filter(F.transform(F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def box_area(box: Column) -> Column:
    """Area of a JSON box, 0 if it cannot be read."""
    b = F.from_json(box, "x1 double, y1 double, x2 double, y2 double")
    return F.coalesce((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]), F.lit(0.0))


def frame_count(duration: Column) -> Column:
    """Frames to take of a clip: 1 under 10 s or of unknown length, 2 under 60, 4 to 300, else 6."""
    return F.when(duration.isNull() | (duration < 10), 1).when(duration < 60, 2).when(duration <= 300, 4).otherwise(6)


def sample_times(duration: Column, count: Column) -> Column:
    """Centres of `count` equal parts of a clip."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: duration * (i + 0.5) / count)


def seek_centres(duration: Column) -> Column:
    """Where to look for faces in a clip: centres of parts of 4 s, from 30 s on of 5 s, six at most; the start of a clip
    of no or unknown length."""
    parts = F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(duration / F.when(duration < 30, 4.0).otherwise(5.0)))).cast("int")
    return F.when(duration > 0, F.transform(sample_times(duration, parts), lambda x: F.round(x, 3))).otherwise(F.array(F.lit(0.0)))


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, 1 at most, null of nothing."""
    return F.least(F.lit(1.0), F.try_divide(part.cast("double"), whole.cast("double")))


def place_4dp(coordinate: Column) -> Column:
    """A coordinate to four places (some ten metres), half away from zero."""
    return F.round(coordinate, 4)


def interval_total(starts: Column, ends: Column, stop: Column) -> Column:
    """Summed length of intervals; one without an end closes at `stop`."""
    return F.aggregate(F.transform(starts, lambda s, i: F.greatest(F.lit(0.0), F.coalesce(F.get(ends, i), stop) - s)), F.lit(0.0), lambda a, x: a + x)


def fuzzy_score(query: str, text: Column) -> Column:
    """1000 - 4 * first place - gaps of the query's letters in order, case ignored; -1 if they are not all there, 0 of
    an empty query."""
    low = F.lower(text)
    if not query:
        return F.lit(0)
    at: Column = F.lit(0)
    first: Column | None = None
    gaps, ok = F.lit(0), F.lit(True)
    for c in query.lower():
        place = F.when(ok, F.instr(low.substr(at + 1, F.length(low)), c)).otherwise(0)
        ok = ok & (place > 0)
        gaps = gaps + (F.lit(0) if first is None else place - 1)
        first = place - 1 if first is None else first
        at = at + place
    return F.when(ok, 1000 - 4 * first - gaps).otherwise(-1).cast("int")


def pct(done: Column, total: Column) -> Column:
    """Percentage to one place, half-even, 0 of nothing."""
    return F.when(total > 0, F.bround(100.0 * done / total, 1)).otherwise(0.0)


def state_label(done: Column, total: Column) -> Column:
    return F.when(done == 0, "untouched").when(done < total, "in-progress").otherwise("complete")


def primary_rule(rules: Column, priority: Sequence[str]) -> Column:
    """The first rule of the priority list that holds, else the first rule."""
    order = F.array(*map(F.lit, priority))
    return F.coalesce(F.get(F.filter(order, lambda r: F.array_contains(rules, r)), F.lit(0)), F.get(rules, F.lit(0)))


def reason(rule: Column, templates: Mapping[str, str], value: Column) -> Column:
    """A sentence by rule, its %s filled with a value."""
    out = F.lit(None).cast("string")
    for name, text in templates.items():
        out = F.when(rule == name, F.format_string(text, value.cast("string"))).otherwise(out)
    return out


# Extensions of videos, and in least_plausible_bytes the bytes a pixel, a still and any file have at least.
VIDEO_TYPES = ("MP4", "MOV", "M4V", "AVI", "3GP", "MPG", "MKV", "WEBM")


def least_plausible_bytes(kind: Column, duration: Column, width: Column, height: Column, per_second: float) -> Column:
    """A floor under the size of a whole file: by length for videos, by pixels for stills."""
    video = F.coalesce(F.upper(kind).isin(*VIDEO_TYPES), F.lit(False))
    by_length = F.when(duration > 0, duration * per_second)
    by_pixels = F.greatest(F.lit(300_000.0), width * height / 1e6 * 80_000)
    return F.greatest(F.lit(50_000.0), F.when(video, by_length).otherwise(F.coalesce(by_pixels, F.lit(300_000.0))))


def file_class(exists: Column, size: Column, floor: Column, head_reads: Column, decodes: Column) -> Column:
    """missing, truncated, broken, corrupt or unknown, of a file on disk."""
    tiny = size < floor
    return F.when(~exists | (size == 0), "missing").when(tiny & head_reads, "truncated").when(tiny, "broken").when(~decodes, "corrupt").otherwise("unknown")


def human_bytes(size: Column) -> Column:
    out, n = F.lit(None).cast("string"), size.cast("double")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB")):
        out = F.when(n >= 1024.0**power, F.format_string(f"%.1f{unit}", n / 1024.0**power)) if power == 4 else out.when(n >= 1024.0**power, F.format_string(f"%.1f{unit}", n / 1024.0**power))
    return out.when(n >= 1024, F.format_string("%.0fKB", n / 1024)).when(n.isNull(), "?").otherwise(F.format_string("%.0fB", n))


def period_key(year: Column, month: Column, day: Column | None = None, week: Column | None = None) -> Column:
    """m:Y-M, d:Y-M-D or w:Y-M-W."""
    if day is not None:
        return F.format_string("d:%d-%d-%d", year, month, day)
    return F.format_string("m:%d-%d", year, month) if week is None else F.format_string("w:%d-%d-%d", year, month, week)
