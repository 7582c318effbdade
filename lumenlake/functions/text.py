"""Scalar expressions on keys, urls, labels, logs and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


# Keys and urls


def key_parts(key: Column) -> Column:
    return F.filter(F.split(key, "/"), lambda x: x != "")


def folder_of(key: Column) -> Column:
    """The first two non-empty parts of a key; null for keys with fewer."""
    parts = key_parts(key)
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, 1, 2)))


def before(text: Column, separator: str = "/frames/") -> Column:
    """Text before the first ``separator``; all of it where there is none."""
    return F.split_part(text, F.lit(separator), F.lit(1))


def parse_key(key: Column, own_platform: str = "own") -> Column:
    """``struct(platform, video_code, video_id, n, sec)`` of a frame's key, else null.

    Four parts are read only under ``own_platform`` (the code joins user and video with a dot), three
    parts under any; the last is ``<n>_<sec>.png``. Names that are no numbers give null instead of an error.
    """
    parts = F.split(key, "/")
    name = F.element_at(parts, -1)
    n, sec = try_cast(F.regexp_extract(name, r"^(\d+)_(\d+(?:\.\d+)?)\.png$", 1), "int"), try_cast(F.regexp_extract(name, r"^(\d+)_(\d+(?:\.\d+)?)\.png$", 2), "double")
    four = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == own_platform)
    three = F.size(parts) == 3
    code = F.when(four, F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(F.get(parts, F.lit(1)))
    video = F.when(four, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when((four | three) & n.isNotNull() & sec.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("platform"), code.alias("video_code"), video.alias("video_id"), n.alias("n"), sec.alias("sec")))


def video_key(key: Column, platforms: tuple[str, ...] = ("instagram", "tiktok")) -> Column:
    """``struct(platform, code)`` of ``<platform>/<code>/video.mp4`` with an allowed platform, else null."""
    p, c = (F.regexp_extract(key, r"^([^/]+)/([^/]+)/video\.mp4$", i) for i in (1, 2))
    return F.when((c != "") & p.isin(*platforms), F.struct(p.alias("platform"), c.alias("code")))


def frame_index(name: Column, position: Column) -> Column:
    """Index in a frame's file name ``<idx>_<sec>.png``; names without an underscore take their position."""
    stem = F.regexp_replace(name, r"\.png", "")
    return F.when(name.contains("_"), try_cast(F.split_part(stem, F.lit("_"), F.lit(1)), "int")).otherwise(position.cast("int"))


def frame_second(name: Column, position: Column) -> Column:
    stem = F.regexp_replace(name, r"\.png", "")
    return F.when(name.contains("_"), try_cast(F.split_part(stem, F.lit("_"), F.lit(2)), "double")).otherwise(position.cast("double"))


def frame_name(index: Column, second: Column) -> Column:
    """``<idx>_<sec, two decimals>.png``. Ties of the third decimal round half up on the shortest decimal."""
    return F.format_string("%d_%.2f.png", index, second)


def is_frame_name(name: Column) -> Column:
    return name.rlike(r"^\d+_\d+\.\d+\.png$")


def strip_extension(name: Column, known_only: bool = False) -> Column:
    """Without what follows the last dot. That cuts dotted codes in half; ``known_only`` removes media extensions alone."""
    return F.regexp_replace(name, r"(?i)\.(mp4|mov|avi|mkv|webm|png|jpe?g|webp)$" if known_only else r"\.[^.]*$", "")


def prefixed(path: Column, platform: Column) -> Column:
    """``platform/path`` unless the path already begins with it; leading slashes are dropped."""
    bare = F.regexp_replace(path, "^/+", "")
    return F.when(F.startswith(path, F.concat(platform, F.lit("/"))), path).otherwise(F.concat(platform, F.lit("/"), bare))


def shortcode(url: Column, domain: str = "instagram.com") -> Column:
    """Short code of a reel's url; text that is no url is returned as it is, other urls give null."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.when(~url.contains("http"), url).when(url.contains(domain) & url.contains("/reel/"), last)


def normalised_url(base: Column, trailing_slash: bool = False) -> Column:
    """Without one leading slash, without repeated slashes (but after a scheme), with a trailing slash if asked for."""
    bare = F.when((F.length(base) > 1) & F.startswith(base, F.lit("/")), F.substring(base, F.lit(2), F.length(base))).otherwise(base)
    flat = F.regexp_replace(bare, "([^:]/)/+", "$1")
    return F.when(F.lit(trailing_slash) & ~F.endswith(flat, F.lit("/")), F.concat(flat, F.lit("/"))).otherwise(flat)


def embedded_value(page: Column, field: str = "video_url") -> Column:
    """The first ``"field":"value"`` in a page or JSON text, with escaped ampersands restored; null if there is none."""
    found = F.regexp_extract(page, f'"{field}"\\s*:\\s*"([^"]+)"', 1)
    return F.nullif(F.replace(found, F.lit("\\u0026"), F.lit("&")), F.lit(""))


def extension(filename: Column, allowed: tuple[str, ...] = ("mp4", "mov", "avi", "mkv", "webm"), default: str = "mp4") -> Column:
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.when(ext.isin(*allowed), ext).otherwise(F.lit(default))


def random_id() -> Column:
    """A random UUID per row; it differs at every evaluation, so it is no key."""
    return F.uuid()


def object_key(user_id: Column, item_id: Column, kind: str = "vid", extension: str = "mp4") -> Column:
    """``users/<user>/<kind>/<id>.<extension>``; null if a part is null."""
    return F.concat(F.lit("users/"), user_id.cast("string"), F.lit(f"/{kind}/"), item_id.cast("string"), F.lit(f".{extension}"))


def object_url(key: Column, bucket: str, region: str) -> Column:
    """Address of an object in a bucket of a region."""
    return F.concat(F.lit(f"https://{bucket}.s3.{region}.amazonaws.com/"), key)


def job_name(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit("-"))


# Values


def truthy(first: Column, *others: Column, zero: bool = True) -> Column:
    """``a or b or ...``: null, empty text and (with ``zero``) 0 count as missing; the last value stands in any case."""
    chain = [first, *others]
    out = chain[-1]
    for c in reversed(chain[:-1]):
        text = c.cast("string")
        missing = c.isNull() | (text == "") | (F.coalesce(c.try_cast("double") == 0, F.lit(False)) if zero else F.lit(False))
        out = F.when(~missing, c).otherwise(out)
    return out


def float_text(c: Column) -> Column:
    """A DOUBLE as Python's ``repr`` writes it for 1e-4 <= |x| < 1e16: no exponent, always a decimal point."""
    plain = c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.abs(c)
    return F.when((size >= 1e-4) & (size < 1e16) & plain.contains("E"), digits).otherwise(plain)


def short_number(n: Column) -> Column:
    """Label with one decimal and K or M; 999,950 shows as 1000.0K, as it is rounded after the unit is chosen."""
    one = lambda x: F.regexp_replace(F.format_number(x, 1), ",", "")
    return F.when(n >= 1_000_000, F.concat(one(n / 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(one(n / 1_000), F.lit("K"))).otherwise(n.cast("string"))


def whole_number(n: Column) -> Column:
    """Label without decimals, half up, with K or M."""
    w = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(n >= 1_000_000, F.concat(w(n / 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(w(n / 1_000), F.lit("K"))).otherwise(n.cast("string"))


def duration_label(start: Column, end: Column) -> Column:
    """``1d 2h 3m 4s`` of the absolute difference without zero units; '0s' for none, 'Processing...' without an end."""
    s = F.abs(F.unix_timestamp(end) - F.unix_timestamp(start))
    units = [(F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    label = F.concat_ws(" ", *(F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in units))
    return F.when(start.isNull() | end.isNull(), F.lit("Processing...")).otherwise(F.coalesce(F.nullif(label, F.lit("")), F.lit("0s")))


def iso_utc(ts: Column) -> Column:
    """ISO 8601 to the second with ``+00:00``; the session's time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def toggled(status: Column) -> Column:
    return F.when(status == "Active", F.lit("Not Active")).otherwise(F.lit("Active"))


# Logs


def beacon(line: Column, field: str = "item_done") -> Column:
    """Number in the first brace group of a log line; null where there is none or it is no JSON."""
    return try_cast(F.get_json_object(F.nullif(F.regexp_extract(line, r"\{[^}]+\}", 0), F.lit("")), f"$.{field}"), "int")


def check_marks(line: Column, mark: str = "✔") -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def log_tail(log: Column, n: int | None) -> Column:
    """The last ``n`` lines; all of them for None."""
    lines = F.split(log, "\n")
    return lines if n is None else F.slice(lines, -F.least(F.lit(n), F.size(lines)), F.lit(n))


# Rectangles

RECT = "struct<x:int,y:int,w:int,h:int>"


def last_rect(log: Column) -> Column:
    """``struct(x, y, w, h)`` of the last ``crop=w:h:x:y`` in a text; null if there is none."""
    got = F.try_element_at(F.regexp_extract_all(log, F.lit(r"crop=(\d+:\d+:\d+:\d+)"), F.lit(1)), F.lit(-1))
    p = lambda i: F.split_part(got, F.lit(":"), F.lit(i)).cast("int")
    return F.when(got.isNotNull(), F.struct(p(3).alias("x"), p(4).alias("y"), p(1).alias("w"), p(2).alias("h")))


def even(n: Column) -> Column:
    return n + n % 2


def probe_times(duration: Column, probes: int) -> Column:
    """``probes`` evenly spaced times within a duration; none for a missing or zero one."""
    return F.when(F.coalesce(duration, F.lit(0.0)) > 0, F.transform(F.sequence(F.lit(1), F.lit(probes)), lambda k: duration * k / (probes + 1))).otherwise(F.array().cast("array<double>"))


def should_crop(width: Column, height: Column, crop_width: Column, crop_height: Column, least: float) -> Column:
    return ((width - crop_width) / width >= least) | ((height - crop_height) / height >= least)


def seconds(frame: Column, fps: Column, default: float = 25.0) -> Column:
    return frame / F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(default))


def contains_term(term: str | None, *columns: Column) -> Column:
    """Literal, case-insensitive: any column contains the term; a blank term matches every row."""
    if not (term or "").strip():
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(term.strip().lower()), F.lit(False))
    return hit
