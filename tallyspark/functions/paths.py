"""Project slugs, worktrees, display paths and repository keys as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of the data format: what stands between a project's slug and a worktree's name.
MARKER = "--claude-worktrees-"
#: The ports that go without saying.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def slug_of(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def path_of(slug: Column) -> Column:
    """The lossy way back: every dash is a separator."""
    return F.translate(slug, "-", "/")


def parent_slug(slug: Column) -> Column:
    at = F.instr(slug, F.lit(MARKER))
    return F.when(at > 1, F.substring(slug, F.lit(1), at - 1)).otherwise(slug)


def is_worktree(slug: Column) -> Column:
    return parent_slug(slug) != slug


def parent_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.+?)[/\\]\.claude[/\\]worktrees[/\\]", 1)
    return F.when(found == "", path).otherwise(found)


#: Fixed value: where home folders lie.
HOME = r"^(/(Users|home)/[^/]+|[A-Za-z]:\\Users\\[^\\]+)"


def display_path(path: Column) -> Column:
    return F.regexp_replace(path, HOME, "~")


def display_name(path: Column) -> Column:
    """The last segment that isn't empty, else the path."""
    return F.coalesce(F.element_at(F.filter(F.split(path, r"[/\\]"), lambda s: s != ""), -1), path)


def repo_id(remote: Column, subpath: Column) -> Column:
    """host[:port]/path[#subpath] of a git remote, lower-case; null where it names no host (files, drives, bare paths)."""
    raw = F.trim(remote)
    schemed = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_extract(raw, r"^[^:]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    port = F.regexp_extract(raw, r"^[^:]+://(?:[^/@]*@)?(?:\[[^\]]*\]|[^/:?#]*):([0-9]+)", 1)
    usual = F.element_at(F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv)), scheme)
    port = F.when((port == "") | (port == F.coalesce(usual, F.lit(""))), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(raw, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    # a '+' is itself in a path
    path = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    scp = r"^(?:[^@/]+@)?([^:/]+):(.*)$"
    scp_host, scp_path = F.regexp_extract(raw, scp, 1), F.regexp_extract(raw, scp, 2)
    host, port, path = F.when(schemed, host).otherwise(scp_host), F.when(schemed, port).otherwise(""), F.when(schemed, path).otherwise(scp_path)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+|/+$", ""), "#", "%23")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, port, F.lit("/"), path)), r"\.git$", ""), "/+$", "")
    sub = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(subpath, F.lit("")), r"\\", "/"), "^/+|/+$", ""))
    none = raw.isNull() | (host == "") | (path == "") | (scheme == "file") | (~schemed & host.rlike("^[A-Za-z]$"))
    return F.when(~none, F.when(sub == "", key).otherwise(F.concat(key, F.lit("#"), sub)))
