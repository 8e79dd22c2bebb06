"""Which addresses an article may be fetched from."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_ip(address: str) -> bool:
    """Whether an address is on the public internet; those that hold another, like mapped ones, are judged
    by it."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    inner = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
    return allowed_ip(str(inner)) if inner else ip.is_global and not ip.is_multicast


LOCAL = r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal|0|127(\.\d+){3}|10(\.\d+){3}|192\.168(\.\d+){2}|169\.254(\.\d+){2}|172\.(1[6-9]|2\d|3[01])(\.\d+){2}|\[.*\])$"


def allowed_url(url: Column) -> Column:
    """http or https, a host that isn't local, no user information, no unusual port."""
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)
    host = F.regexp_replace(authority, r":\d*$", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    return (authority != "") & ~F.contains(authority, F.lit("@")) & ~host.rlike(LOCAL) & port.isin("", "80", "443")


#: What can go wrong with a fetch, and whether a later try can't mend it. Fixed values.
FAILURES = {
    "bad_scheme": True, "dns_failure": False, "blocked_address": True, "too_many_redirects": True, "bad_status": False, "disallowed_content_type": True, "too_large": True,
    "empty": True, "transport": False,
}
#: Statuses of a request that is at fault but may be sent again. Fixed values.
RETRIED = (408, 429)


def fetch_failure(status: Column, error: Column) -> Column:
    """The name of what went wrong: an error by its own name, a status that is none of success as bad_status;
    null if nothing did. A name that isn't known counts as transport's."""
    known = F.when(error.isin(*FAILURES), error).otherwise("transport")
    return F.when(error.isNotNull(), known).when(~status.between(200, 299), "bad_status")


def permanent_failure(status: Column, error: Column) -> Column:
    """Failures that a later try won't mend; null counts as none."""
    lasting = error.isin(*[name for name, lasts in FAILURES.items() if lasts])
    return F.coalesce(lasting, F.lit(False)) | F.coalesce(status.between(400, 499) & ~status.isin(*RETRIED), F.lit(False))
