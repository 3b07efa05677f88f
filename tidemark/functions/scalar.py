"""Column functions on times, addresses, identities and job fields. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWITCH_HOSTS = ["twitch.tv", "www.twitch.tv", "m.twitch.tv"]
YOUTUBE_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com"]

# Job states that count as running in the job list, as interrupted on restart, and as undeletable.
RUNNING = [
    "queued", "processing", "inspecting", "downloading", "trimming", "analyzing", "transcribing", "rendering",
    "composing", "finalizing", "uploading",
]
INTERRUPTIBLE = [
    "queued", "inspecting", "downloading", "trimming", "analyzing", "detecting_scenes", "analyzing_layouts",
    "composing", "transcribing", "rendering", "finalizing", "uploading",
]
UNDELETABLE = ["queued", "inspecting", "downloading", "trimming", "analyzing", "transcribing", "rendering", "uploading"]


def _number(text: Column) -> Column:
    return text.cast("long")


def parse_timecode(text: Column) -> Column:
    """`MM:SS` or `HH:MM:SS` to seconds; null when it is neither. Minutes of `MM:SS` are unbounded."""
    clean = F.trim(text)
    part = F.split(clean, ":")
    return F.when(clean.rlike(r"^[0-9]+:[0-5][0-9]$"), _number(part[0]) * 60 + _number(part[1])).when(
        clean.rlike(r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$"), _number(part[0]) * 3600 + _number(part[1]) * 60 + _number(part[2])
    )


def parse_timecode_lenient(text: Column) -> Column:
    """Also plain seconds with a fraction; minutes and seconds are at most 59."""
    clean = F.trim(text)
    part = F.split(clean, ":")
    three = clean.rlike(r"^[0-9]+:[0-9]+:[0-9]+$")
    two = clean.rlike(r"^[0-9]+:[0-9]+$")
    hours = F.when(three, _number(part[0])).otherwise(F.lit(0))
    minutes = F.when(three, _number(part[1])).otherwise(_number(part[0]))
    seconds = F.when(three, _number(F.get(part, F.lit(2)))).otherwise(_number(F.get(part, F.lit(1))))
    return F.when(clean.rlike(r"^[0-9]+(\.[0-9]+)?$"), clean.try_cast("double")).when(
        (two | three) & (minutes <= 59) & (seconds <= 59), (hours * 3600 + minutes * 60 + seconds).cast("double")
    )


def clip_interval_problem(start: Column, end: Column, maximum: int = 1800, duration: Column | None = None) -> Column:
    """Why a clip interval is not valid, or `ok`."""
    problem = F.when(start.isNull() | end.isNull(), "invalid_timecode").when(end <= start, "end_not_after_start").when(
        end - start > maximum, "exceeds_maximum_duration"
    )
    if duration is not None:
        problem = problem.when(end > duration + 0.5, "end_beyond_recording")
    return problem.otherwise("ok")


def _hms(total: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)


def format_timecode(seconds: Column, rounding: str = "floor") -> Column:
    """`HH:MM:SS`. `rounding`: `floor`, `even` (half to even), or `short` (half up; `MM:SS` under one hour)."""
    if rounding == "floor":
        return _hms(F.greatest(F.lit(0), F.floor(seconds)).cast("long"))
    if rounding == "even":
        return _hms(F.greatest(F.lit(0), F.rint(seconds)).cast("long"))
    total = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    short = F.format_string("%02d:%02d", F.floor(total % 3600 / 60), total % 60)
    return F.when(total >= 3600, _hms(total)).otherwise(short)


def format_subtitle_time(seconds: Column) -> Column:
    """`H:MM:SS.cc` from rounded hundredths."""
    cs = F.greatest(F.lit(0), F.rint(seconds * 100)).cast("long")
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100
    )


def wrap_caption(text: Column, limit: int = 18) -> Column:
    """Words filled greedily into lines of `limit` characters; two lines are kept, joined by a hard break."""
    clean = F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), "{}", "()")
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.concat_ws(" ", acc["line"], word)
        full = (acc["line"] != "") & (F.length(longer) > limit)
        return F.struct(
            # Two lines are all that is shown, so the list stops growing there.
            F.when(full & (F.size(acc["lines"]) < 2), F.array_append(acc["lines"], acc["line"])).otherwise(acc["lines"]).alias("lines"),
            F.when(full | (acc["line"] == ""), word).otherwise(longer).alias("line"),
        )

    def finish(acc: Column) -> Column:
        lines = F.when(acc["line"] != "", F.array_append(acc["lines"], acc["line"])).otherwise(acc["lines"])
        return F.array_join(F.slice(lines, 1, 2), "\\N")

    return F.aggregate(words, empty, add, finish)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def deep_link(url: Column, seconds: Column) -> Column:
    """The address with a start time: `t=1h42m30s` or `t=<seconds>`; other query parameters stay. Null if unsupported."""
    value = F.greatest(F.lit(0), F.rint(seconds)).cast("long")
    host = host_of(url)
    stamp = F.when(
        host.endswith("twitch.tv"), F.format_string("%dh%dm%ds", F.floor(value / 3600), F.floor(value % 3600 / 60), value % 60)
    ).when(host.isin([*YOUTUBE_HOSTS, "youtu.be"]), value.cast("string"))
    raw = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.instr(p, "=") > 0, F.url_decode(F.regexp_replace(p, "^[^=]*=", "")))
            .otherwise("").alias("v"),
        ),
    )
    names = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit("t"))))
    value_of = lambda name: F.element_at(F.filter(pairs, lambda p: p["k"] == name), -1)["v"]
    query = F.array_join(
        F.transform(
            names,
            lambda n: F.concat(F.url_encode(n), F.lit("="), F.url_encode(F.when(n == "t", stamp).otherwise(value_of(n)))),
        ),
        "&",
    )
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(stamp.isNotNull(), F.concat(base, F.lit("?"), query, fragment))


def source_identity(url: Column) -> Column:
    """Struct (platform, vod_id); null when the address does not name one recording."""
    host = host_of(url)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    twitch = F.regexp_extract(path, r"^/videos/([0-9]+)/?$", 1)
    query_v = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit(""))
    tail = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)
    video = F.when(host == "youtu.be", F.regexp_replace(path, "^/+|/+$", "")).when(
        host.isin(YOUTUBE_HOSTS), F.when(query_v != "", query_v).when(path.rlike("^/(live|shorts)/"), tail)
    )
    valid = video.rlike(r"^[A-Za-z0-9_-]{6,64}$")
    return F.when(
        host.isin(TWITCH_HOSTS) & (twitch != ""), F.struct(F.lit("twitch").alias("platform"), twitch.alias("vod_id"))
    ).when(valid, F.struct(F.lit("youtube").alias("platform"), video.alias("vod_id")))


def source_problem(url: Column, form: str = "clip") -> Column:
    """Why an address is refused by the `clip` or the `analysis` form, or `ok`."""
    host = host_of(url)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    if form == "clip":
        return F.when(~host.isin(TWITCH_HOSTS), "unsupported_host").when(~path.contains("/videos/"), "not_a_recording").otherwise("ok")
    return F.when(~host.isin([*TWITCH_HOSTS, *YOUTUBE_HOSTS, "youtu.be"]), "unsupported_host").when(
        source_identity(url).isNull(), "not_a_recording"
    ).otherwise("ok")


def normalize_identity(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def clean_tags(tags: Column, most: int = 50, length: int = 100) -> Column:
    """Trimmed, non-empty tags of at most `length` characters; null for a list of more than `most`, which is refused."""
    kept = F.filter(tags, lambda t: F.trim(t) != "")
    return F.when(F.size(tags) <= most, F.transform(kept, lambda t: F.substring(F.trim(t), 1, length)))


def status_bucket(status: Column) -> Column:
    return F.when(status.isin(RUNNING), "running").when(status.isin("ready", "completed"), "completed").when(
        status == "failed", "failed"
    )


def error_class(stderr: Column) -> Column:
    text = F.lower(stderr)
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.when(has("login required", "cookies", "subscriber"), "login_required").when(
        has("not found", "does not exist", "deleted"), "unavailable"
    ).when(has("private", "restricted"), "restricted").otherwise("other")


def last_useful_line(stderr: Column, length: int = 500) -> Column:
    lines = F.filter(F.transform(F.split(stderr, "\n"), lambda line: F.trim(line)), lambda x: x != "")
    return F.substring(F.get(lines, F.size(lines) - 1), 1, length)


def parse_rate(text: Column) -> Column:
    """`30000/1001` to frames per second; 30 when invalid or outside 1 to 120."""
    part = F.split(text, "/")
    top, bottom = part[0].try_cast("double"), F.coalesce(F.get(part, F.lit(1)), F.lit("1")).try_cast("double")
    rate = F.try_divide(top, bottom)
    return F.when(rate.between(1, 120), F.round(rate, 3)).otherwise(30.0)


def fingerprint(*parts: Column) -> Column:
    """Content key of the named parts; an upstream key is simply one of the parts."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def progress_percent(done: Column, total: Column, low: int, high: int) -> Column:
    share = done / F.greatest(F.lit(1), total)
    return F.least(F.lit(100), F.greatest(F.lit(0), F.lit(low) + F.floor((high - low) * share))).cast("long")


def layout_confidence(phase: Column, score: Column, margin: Column) -> Column:
    return F.when(phase == "waiting_or_music", F.greatest(F.lit(0.0), 1 - score)).when(
        phase == "unknown", F.greatest(F.lit(0.0), margin)
    ).otherwise(score)


def elapsed_seconds(created: Column, updated: Column) -> Column:
    """Seconds between two ISO texts; 0 when either cannot be read or time runs backwards."""
    seconds = (F.unix_micros(F.try_to_timestamp(updated)) - F.unix_micros(F.try_to_timestamp(created))) / 1e6
    return F.coalesce(F.greatest(F.lit(0.0), seconds), F.lit(0.0))


def duration_fit(duration: Column, low: float, high: float) -> Column:
    target = F.when(duration < low, F.lit(low)).otherwise(F.lit(high))
    return F.when(duration.between(low, high), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.abs(duration - target) / F.greatest(target, F.lit(1.0)))
    )


def probe_gate(voice: Column, run: Column, min_voice: float = 0.20, min_run: float = 2.0) -> Column:
    """Null when the window should be transcribed, else the reason to skip it."""
    return F.when(voice < min_voice, "voice_ratio_below_threshold").when(run < min_run, "speech_run_too_short")
