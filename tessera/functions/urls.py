"""Repository addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOSTS = ["github.com", "www.github.com"]


def _parts(url: Column) -> Column:
    """Path components: scheme and host off, no query or fragment, none empty."""
    full = F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    path = F.regexp_replace(F.regexp_replace(full, r"^https?://[^/?#]*", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"\.git$", "")


def repository_identifier(url: Column) -> Column:
    """``github_<owner>_<name>_<8 hex digits>``; null if the path has fewer than two parts."""
    parts = _parts(F.lower(F.trim(url)))
    owner, name = F.get(parts, F.lit(0)), _bare(F.get(parts, F.lit(1)))
    return F.concat(F.lit("github_"), owner, F.lit("_"), name, F.lit("_"), F.substring(F.sha2(F.concat(owner, F.lit("/"), name), 256), 1, 8))


def valid(url: Column, hosts: list[str] = HOSTS) -> Column:
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    return F.coalesce(url.rlike(r"^https?://") & host.isin(hosts) & (F.size(_parts(url)) >= 2), F.lit(False))


def owner(url: Column) -> Column:
    return F.get(_parts(F.trim(url)), F.lit(0))


def name(url: Column) -> Column:
    return _bare(F.get(_parts(F.trim(url)), F.lit(1)))


def looks_like(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^https?://github\.com/.+/.+") | text.rlike(r"^github\.com/.+/.+") | text.rlike(r"^.+/.+\.git$"), F.lit(False))
