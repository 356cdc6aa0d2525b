"""Pages fetched over HTTP: addresses in, what the servers answered out, one request per row and task thread."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.columns import MAX_HTML_BYTES

# What a request says of itself, and content types that are read.
AGENT = "Mozilla/5.0 (compatible; cardloom)"
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,*/*;q=0.8"
READ = ("text/html", "application/xhtml+xml")
CHUNK = 1 << 16
FETCHED = "resolved_url string, status int, headers map<string,string>, content_type string, html string, fetch_error string"


def fetch(url: str | None, agent: str = AGENT, timeout: float = 20.0, most: int = MAX_HTML_BYTES) -> dict:
    """One answer: any status counts, redirects are followed, and html is read up to the chunk that passes the limit.

    What can't be fetched has an error and nothing else; a page of another type has no html.
    """
    out = dict.fromkeys(f.strip().split(" ")[0] for f in FETCHED.replace("map<string,string>", "map").split(","))
    if not url or not url.lower().startswith(("http://", "https://")):
        return out | {"fetch_error": "Unsupported protocol"}
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": ACCEPT})
        try:
            answer = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            headers = {k.lower(): v for k, v in answer.headers.items()}
            kind = headers.get("content-type")
            out |= {"resolved_url": answer.geturl(), "status": answer.status, "headers": headers, "content_type": kind}
            if not kind or any(t in kind.lower() for t in READ):
                parts, size = [], 0
                while size <= most and (part := answer.read(CHUNK)):
                    parts.append(part)
                    size += len(part)
                out["html"] = b"".join(parts).decode("utf-8", "replace")
        return out
    except (OSError, ValueError) as e:
        return out | {"fetch_error": type(e).__name__}


def fetch_pages(urls: DataFrame, *, agent: str = AGENT, timeout: float = 20.0, threads: int = 8) -> DataFrame:
    """Adds the answers of the addresses in column url; other columns are passed on, those with the names of FETCHED give way.

    Rows are fetched where they lie: spread them by host before, or keep a host in one partition to be polite to it.
    """
    own = [f.strip().split(" ")[0] for f in FETCHED.replace("map<string,string>", "map").split(",")]
    urls = urls.drop(*own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(lambda u: fetch(u if isinstance(u, str) else None, agent, timeout), pdf["url"]))
                yield pdf.assign(**{k: pd.Series([g[k] for g in got], index=pdf.index, dtype=object) for k in own})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInPandas(run, f"{types}, {FETCHED}")
