"""What is decided about media, requests and calls before and after a network or a model does its part.

Servers, downloads and models lie outside: these operators take what they report as rows and tell what follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators.governance import MEDIA, normalized_url

#: Limits of media, in bytes, seconds and pixels, and the share of a file's size that working on it needs as well.
MOST_BYTES, MOST_S, MOST_PIXELS, HEADROOM = 1 << 30, 3600.0, 3840 * 2160, 0.25
#: Status codes that redirect, that a later download may not meet, and that a call to a provider is repeated at.
REDIRECTS, PASSING, REPEATED = [301, 302, 303, 307, 308], [408, 425, 429], [429, 500, 502, 503, 504]
REDIRECTS_MOST = 5


def probed(df: DataFrame, fps: str, frames: str, width: str, height: str, fourcc: str, longest: float = MOST_S) -> DataFrame:
    """Adds ``duration``, ``codec`` and ``refused``: ``no_stream`` if a figure isn't a positive number, ``too_long`` or ``too_large``.

    ``codec`` are the four characters that an integer packs, lowest byte first.
    """
    good = [(F.abs(F.col(c)) < float("inf")) & (F.col(c) > 0) for c in (fps, frames, width, height)]
    ok = F.coalesce(good[0] & good[1] & good[2] & good[3], F.lit(False))
    duration = F.when(ok, F.col(frames) / F.col(fps))
    codec = F.concat(*(F.char(F.shiftright(F.col(fourcc).cast("int"), 8 * i).bitwiseAND(255)) for i in range(4)))
    why = F.when(~ok, "no_stream").when(duration > longest, "too_long").when(F.floor(F.col(width)) * F.floor(F.col(height)) > MOST_PIXELS, "too_large")
    return df.withColumns({"duration": duration, "codec": codec, "refused": why})


def upload_status(name: Column, declared: Column, size: Column, free: Column, most: int = MOST_BYTES, reserve: int = 0) -> Column:
    """Status of an upload, in the order in which a stream of it is judged: 415 for other endings, 400 for a declared
    length that is no number, 413 for too many bytes declared or sent, 507 where the disk can't hold it and work on it
    beside a ``reserve``, 400 for none, else 200. ``declared`` is a text, null if not given; ``free`` are bytes before it."""
    suffix = F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))
    number = F.when(F.trim(declared).rlike(r"^[+-]?\d{1,18}$"), F.trim(declared).cast("bigint"))
    work = lambda n: F.floor(n * HEADROOM)
    return (
        F.when(~suffix.isin(MEDIA), 415).when(declared.isNotNull() & number.isNull(), 400).when(number > most, 413)
        .when(F.coalesce(F.greatest(number + work(number), F.lit(0)), F.lit(0)) + reserve > free, 507)
        .when(size > most, 413).when(work(size) + reserve > free - size, 507).when(F.coalesce(size, F.lit(0)) == 0, 400).otherwise(200)
    )


def joined(base: Column, location: Column) -> Column:
    """Where a redirect from ``base`` to ``location`` leads: absolute, of the same scheme, of the same host, or beside the path."""
    scheme, host = F.try_parse_url(base, F.lit("PROTOCOL")), F.try_parse_url(base, F.lit("AUTHORITY"))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), location).when(location.startswith("//"), F.concat(scheme, F.lit(":"), location))
        .when(location.startswith("/"), F.concat(root, location)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), location))
    )


def followed(url: Column, answers: Column, limit: int = REDIRECTS_MOST, most: int = MOST_BYTES) -> Column:
    """``struct(url, outcome)`` of a download whose servers gave ``answers``, an array of (status, location, bytes) in order.

    Every address, redirects included, must be one that may be fetched. Outcomes: ``fetched``, ``refused`` address,
    ``no_location``, ``redirect_limit``, ``unavailable`` (may pass), ``inaccessible``, ``too_large``, ``empty``, ``no_answer``.
    """
    state = lambda u, o, n: F.struct(u.alias("url"), o.cast("string").alias("outcome"), n.cast("int").alias("n"))
    none = F.lit(None)

    def step(acc: Column, a: Column) -> Column:
        normal, why = normalized_url(acc.url)
        moved = a.status.isin(REDIRECTS)
        bad = (
            F.when(why.isNotNull(), "refused").when(moved & (F.coalesce(a.location, F.lit("")) == ""), "no_location").when(moved & (acc.n >= limit), "redirect_limit")
            .when(~moved & (a.status.isin(PASSING) | (a.status >= 500)), "unavailable").when(~moved & (a.status >= 400), "inaccessible")
            .when(~moved & (a.bytes > most), "too_large").when(~moved & (F.coalesce(a.bytes, F.lit(0)) == 0), "empty").when(~moved, "fetched")
        )
        nxt = F.when(bad.isNull(), joined(normal, a.location)).otherwise(F.coalesce(normal, acc.url))
        return F.when(acc.outcome.isNotNull(), acc).otherwise(state(nxt, bad, acc.n + 1))

    end = F.aggregate(answers, state(url, none, F.lit(0)), step)
    return F.struct(end.url.alias("url"), F.coalesce(end.outcome, F.lit("no_answer")).alias("outcome"))


def access_status(method: Column, path: Column, origin: Column, authorization: Column, origins: list[str], user: str, token: str, open_paths: list[str] = ["/health"]) -> Column:
    """403 for a changing request from an origin that isn't listed, 401 without the right Basic or Bearer credentials, else 200.

    An empty token asks for none; preflight requests and open paths need none either.
    """
    changing = ~method.isin("GET", "HEAD", "OPTIONS")
    foreign = changing & (F.coalesce(origin, F.lit("")) != "") & ~origin.isin(origins)
    given = F.coalesce(authorization, F.lit(""))
    basic = F.try_to_binary(F.substring(given, 7, 10_000), F.lit("base64"))
    right = (given.startswith("Basic ") & (F.try_validate_utf8(basic.cast("string")) == f"{user}:{token}")) | (given == f"Bearer {token}")
    free = F.lit(not token) | path.isin(open_paths) | (method == "OPTIONS")
    return F.when(foreign, 403).when(~free & ~F.coalesce(right, F.lit(False)), 401).otherwise(200)


ANSWER = T.StructType([T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("attempts", T.IntegerType())])


def called(df: DataFrame, request: str, send: Callable[[str, int], tuple[int | None, str | None]], retries: int = 2) -> DataFrame:
    """Adds ``status``, ``body`` and ``attempts``: what ``send(request, attempt)`` gave, repeated while it may pass.

    A call is repeated, up to ``retries`` times, at 429, 500, 502, 503 and 504 and at a timeout (a status of null). A
    last timeout gives 504, a last failure of the provider 502, as any other refusal; a null request isn't sent.
    """
    rest = df.drop("status", "body", "attempts")

    def one(text: str | None) -> tuple[int | None, str | None, int]:
        if text is None:
            return None, None, 0
        for attempt in range(retries + 1):
            status, body = send(text, attempt)
            if attempt < retries and (status is None or status in REPEATED):
                continue
            if status is None:
                return 504, None, attempt + 1
            return (200, body, attempt + 1) if 200 <= status < 300 else (502, None, attempt + 1)
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([one(None if x is None or x != x else x) for x in b[request]], columns=ANSWER.names, index=b.index)
            yield pd.concat([b, made.astype({"status": "Int32", "attempts": "Int32"})], axis=1)

    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, *ANSWER.fields]))


def leftovers(files: DataFrame, running: DataFrame, key: str, name: str) -> DataFrame:
    """Files of media that no job works on and that a broken one left behind: downloads and folders written aside."""
    aside = F.col(name).rlike(r"(?:\.part|\.tmp)$")
    return files.where(aside).join(running.select(key).distinct(), key, "left_anti")
