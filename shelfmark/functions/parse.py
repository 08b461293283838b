"""Parsers as column expressions: dates, times, clip spans, paths, titles, lyrics, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date_ok(c: Column) -> Column:
    return c.rlike(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$")


def year(c: Column) -> Column:
    return F.when(partial_date_ok(c), F.substring(c, 1, 4).cast("int"))


def time_ms(c: Column) -> Column:
    """[h:]m:ss[.mmm] as milliseconds; null where it is no time."""
    part = lambda i: F.regexp_extract(c, r"^(?:(\d+):)?(\d+):([0-5]\d)(?:[.,](\d{1,3}))?$", i)
    whole = lambda i: F.coalesce(F.try_to_number(part(i), F.lit("999999999")), F.lit(0)).cast("long")
    return F.when(part(3) != "", ((whole(1) * 60 + whole(2)) * 60 + whole(3)) * 1000 + F.rpad(part(4), 3, "0").cast("long"))


def clip(c: Column) -> Column:
    """'start+length', the start in seconds or per cent, as a struct; null where it is malformed."""
    part = lambda i: F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(%?)\+(\d+)$", i)
    start, length = part(1).try_cast("double"), part(3).try_cast("long")
    ok = start.isNotNull() & length.between(6, 600) & ((part(2) == "") | (start <= 100))
    return F.when(ok, F.struct(start.alias("start"), (part(2) == "%").alias("percent"), length.alias("length")))


def clip_span(span: Column, duration_ms: Column) -> Column:
    """From and to in milliseconds, clamped to the track; halves are rounded up."""
    at = F.when(span["percent"], duration_ms * span["start"] / 100).otherwise(span["start"] * 1000)
    length = span["length"] * 1000
    start = F.greatest(F.least(F.floor(at + 0.5), duration_ms - length), F.lit(0))
    return F.struct(start.cast("long").alias("from_ms"), F.least(start + length, duration_ms).cast("long").alias("to_ms"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]{1,8}$", "")


def track_number(name: Column, tag: Column) -> Column:
    """From the tag ('3/12'), else '1-03 title' or '03 title'."""
    first = F.regexp_extract(tag, r"^0*(\d{1,3})(?:/\d+)?$", 1)
    second = F.regexp_extract(name, r"^\d{1,2}-0*(\d{1,2})[ ._-]", 1)
    third = F.regexp_extract(name, r"^0*(\d{1,3})[ ._-]", 1)
    return F.coalesce(*(x.try_cast("int") for x in (first, second, third)))


def clean_title(name: Column, tag: Column) -> Column:
    bare = F.regexp_replace(stem(name), r"^(\d{1,2}-)?\d{1,3}[ ._-]+", "")
    return F.coalesce(F.nullif(F.trim(tag), F.lit("")), F.nullif(F.trim(bare), F.lit("")))


def search_score(text: Column, wanted: str) -> Column:
    """2 for a prefix, 1 where all words occur, else 0; both sides are lower-cased."""
    low, words = F.lower(text), wanted.lower().split()
    every = F.lit(True)
    for w in words:
        every = every & low.contains(w)
    return F.when(low.startswith(wanted.lower()), 2).when(every, 1).otherwise(0)


def human_size(n: Column) -> Column:
    """Bytes to terabytes, with one decimal under 10 and none above, halves rounded up; a dash for null."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = n / float(1024**power)
        out = F.when(n >= 1024**power, F.when(x < 10, F.format_string(f"%.1f {unit}", F.round(x, 1))).otherwise(F.format_string(f"%.0f {unit}", F.round(x, 0)))).otherwise(out)
    return F.when(n.isNull(), "—").otherwise(out)


def message(pattern: str, fields: dict[str, Column]) -> Column:
    """'{n} {n:track|tracks} of {name}': fields put in, and words chosen by whether a number is 1; unknown ones stay as they are."""
    import re

    parts = []
    for p in re.split(r"(\{\w+:[^|{}]*\|[^{}]*\}|\{\w+\})", pattern):
        if m := re.fullmatch(r"\{(\w+):([^|{}]*)\|([^{}]*)\}", p):
            if m[1] in fields:
                parts.append(F.when(fields[m[1]].try_cast("double") == 1, m[2]).otherwise(m[3]))
                continue
        elif (m := re.fullmatch(r"\{(\w+)\}", p)) and m[1] in fields:
            parts.append(F.coalesce(fields[m[1]].cast("string"), F.lit("")))
            continue
        if p:
            parts.append(F.lit(p))
    return F.concat(*parts) if parts else F.lit("")


#: Characters that no file name may hold, and files that systems leave behind.
UNSAFE = r"[\\/:*?\"<>|\x00-\x1f]"
JUNK = r"(?i)(^|/)(__MACOSX/|\._[^/]*$|(thumbs\.db|desktop\.ini|\.ds_store)$)"
CATALOGUE = r"^([A-Za-z]{2,}[A-Za-z0-9]*-[0-9]+[A-Za-z]?)\s+(.+)$"


def safe_name(c: Column) -> Column:
    """A name that every file system takes: marks become _, white space one space, at most 150 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, UNSAFE, "_"), r"\s+", " ")), 1, 150)


def name_problem(new: Column, ext: Column) -> Column:
    """Why a file can't have a name; null where it can (an empty name means the old one)."""
    name = F.trim(new)
    kept = F.lower(name).endswith(F.concat(F.lit("."), F.lower(ext)))
    return F.when(F.length(name) > 200, "too long").when(name.rlike(UNSAFE) | name.isin(".", ".."), "bad characters").when((name != "") & (ext != "") & ~kept, "extension")


def catalogue_guess(name: Column) -> Column:
    """'ABC-001 Title' as (catalog_no, title); any other name is a title."""
    name = F.trim(name)
    number = F.upper(F.regexp_extract(name, CATALOGUE, 1))
    return F.struct(F.nullif(number, F.lit("")).alias("catalog_no"), F.when(number != "", F.trim(F.regexp_extract(name, CATALOGUE, 2))).otherwise(name).alias("title"))


def language(header: Column) -> Column:
    """ja where Japanese comes first in an Accept-Language header, else zh."""
    first = F.lower(F.trim(F.split(F.coalesce(header, F.lit("")), ",")[0]))
    return F.when(first.startswith("ja"), "ja").otherwise("zh")


def expiry(seconds: Column, lifetime: int, step: int = 600) -> Column:
    """The first mark of the step at or after the end of the lifetime."""
    return (F.ceil((seconds + lifetime) / step) * step).cast("long")


def series(c: Column) -> Column:
    """A series name, without the placeholders for none."""
    name = F.trim(c)
    return F.when((name != "") & ~F.lower(name).isin("其他", "other", "なし", "-"), name)


def quality(fmt: Column) -> Column:
    """How good a format struct (lossless, bits, rate, kbps) sounds: lossless first, then bits, rate and bit rate."""
    part = lambda f, by: F.coalesce(fmt[f].cast("double"), F.lit(0.0)) * by
    return F.when(F.coalesce(fmt["lossless"], F.lit(False)), 1e6).otherwise(0.0) + part("bits", 1e3) + part("rate", 1e-3) + part("kbps", 1e-3)


def cover(json: Column) -> Column:
    """A cover reference as (file, picture, mode): a file id or a picture's SHA-256; null where it is neither."""
    v = F.from_json(json, "file string, picture string, mode string")
    file = F.nullif(v["file"], F.lit(""))
    picture = F.when(file.isNull() & v["picture"].rlike("^[0-9a-f]{64}$"), v["picture"])
    mode = F.when(v["mode"] == "add", "add").otherwise("replace")
    return F.when(file.isNotNull() | picture.isNotNull(), F.struct(file.alias("file"), picture.alias("picture"), mode.alias("mode")))


STREAM = "struct<codec_type:string,codec_name:string,width:int,height:int,attached_pic:int,avg_frame_rate:string,r_frame_rate:string,sample_rate:string,channels:int,bits_per_raw_sample:string>"
LOSSLESS = ("flac", "alac", "ape", "wavpack", "tta", "truehd", "mlp")


def frame_rate(rate: Column) -> Column:
    """'30000/1001' as 29.97; null where a part is missing or 0."""
    part = lambda i: F.regexp_extract(rate, r"^(\d+)/(\d+)$", i).try_cast("double")
    return F.when((part(1) > 0) & (part(2) > 0), F.round(part(1) / part(2), 3))


def probed(streams: Column, kind: Column) -> Column:
    """What a listing shows of a file's streams: the first video that is no picture, the first audio, whether there is a cover."""
    pictures = F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["attached_pic"], F.lit(0)) > 0))
    video = F.get(F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    audio = F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))
    lossless = audio["codec_name"].isin(*LOSSLESS) | audio["codec_name"].startswith("pcm_")
    return F.struct(
        F.when(kind == "video", video["codec_name"]).alias("vcodec"),
        F.when(kind == "video", F.coalesce(frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"]))).alias("fps"),
        audio["codec_name"].alias("acodec"),
        F.nullif(audio["sample_rate"].try_cast("int"), F.lit(0)).alias("rate"),
        F.when(lossless, F.lit(True)).alias("lossless"),
        F.when(lossless, F.nullif(audio["bits_per_raw_sample"].try_cast("int"), F.lit(0))).alias("bits"),
        F.when((kind == "audio") & (F.size(pictures) > 0), F.lit(True)).alias("cover"),
    )


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """'{a} [({b})]' compiled to a column: a bracketed group goes where a field in it is null or empty."""
    import re

    def plain(s: str) -> tuple[Column, list[Column]]:
        parts, used = [], []
        for p in re.split(r"(\{\w+\})", s):
            if p.startswith("{"):
                used.append(fields[p[1:-1]])
                parts.append(F.coalesce(fields[p[1:-1]], F.lit("")))
            elif p:
                parts.append(F.lit(p))
        return F.concat(*parts) if parts else F.lit(""), used

    out = []
    for group in re.split(r"(\[[^\]]*\])", pattern):
        if not group:
            continue
        text, used = plain(group[1:-1] if group.startswith("[") else group)
        if group.startswith("[") and used:
            full = F.lit(True)
            for u in used:
                full = full & (F.coalesce(u, F.lit("")) != "")
            text = F.when(full, text).otherwise("")
        out.append(text)
    return F.concat(*out)


def unescaped(c: Column) -> Column:
    """The common HTML entities; ampersands last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
