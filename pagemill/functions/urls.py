"""URL parts and reference resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import blank_to_null, let

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*:"
_AUTHORITY = rf"^(?:{_SCHEME})?//([^/?#]*)"
_HOST = rf"^{_SCHEME}//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-cased host without credentials and port; null when there is none."""
    return F.lower(blank_to_null(F.regexp_extract(url, _HOST, 1)))


def netloc(url: Column) -> Column:
    """Authority as written: port, credentials and case kept, empty when absent."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def netloc_key(url: Column) -> Column:
    return F.lower(netloc(url))


def stripped_domain(url: Column) -> Column:
    """Scheme removed, then everything from the first slash; a slashless query stays."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/.*$", "")


def request_target(url: Column) -> Column:
    """Path, query and fragment; ``/`` when there is none of them."""
    rest = F.regexp_replace(url, rf"^(?:{_SCHEME})?//[^/?#]*", "")
    return F.when(rest == "", F.lit("/")).otherwise(
        F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    )


def decoded(text: Column) -> Column:
    """Percent-encoded bytes as characters; a percent sign without two digits and a plus sign stay."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.try_url_decode(safe)).otherwise(text)


def is_http(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(
        r"(?i)^https?://(?:[^/?#@\s]*@)?(?:\[[^\]/?#@\s]+\]|[^/?#:@\s\[\]]+)(?::[0-9]+)?(?:[/?#]|$)"
    )


def _without_dots(path: Column) -> Column:
    def rejoin(parts: Column) -> Column:
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, p: F.when(p == ".", acc)
            .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(p))),
        )
        closing = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(kept, "/"), closing)

    joined = let(F.split(path, "/", -1), rejoin)
    return F.regexp_replace(F.concat(F.lit("/"), joined), "^/+", "/")


def resolve(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base`` (relative, rooted, protocol-relative, query-only, absolute)."""
    root = F.regexp_extract(base, rf"^({_SCHEME}//[^/?#]*)", 1)
    folder = F.regexp_extract(base, rf"^{_SCHEME}//[^/?#]*(/[^?#]*/|/)?", 1)

    def by_path(r: Column) -> Column:
        full = F.when(F.startswith(r, F.lit("/")), F.regexp_extract(r, "^([^?#]*)", 1)).otherwise(
            F.concat(
                F.when(folder == "", F.lit("/")).otherwise(folder),
                F.regexp_extract(r, "^([^?#]*)", 1),
            )
        )
        path = let(
            full, lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), _without_dots(p)).otherwise(p)
        )
        return F.concat(root, path, F.regexp_extract(r, r"^[^?#]*([\s\S]*)$", 1))

    def pick(r: Column) -> Column:
        return (
            F.when(r == "", base)
            .when(r.rlike(rf"^{_SCHEME}"), r)
            .when(
                F.startswith(r, F.lit("//")),
                F.concat(F.regexp_extract(base, rf"^({_SCHEME})", 1), r),
            )
            .when(F.startswith(r, F.lit("#")), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), r))
            .when(F.startswith(r, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#][\s\S]*$", ""), r))
            .otherwise(by_path(r))
        )

    return let(ref, pick)
