"""Text keys: normalisation, fuzzy de-dup key, job / company ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobloom.constants import (LEGAL_SUFFIX_ALTERNATIVES, PY_SPACE_CLASS, PY_WORD_CLASS,
                               TITLE_FOLDS)

_NON_WORD = f"[^{PY_WORD_CLASS}{PY_SPACE_CLASS}]"
_SPACE_RUN = f"[{PY_SPACE_CLASS}]+"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())     # the characters of PY_SPACE_CLASS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_c(col), F.lit(_SPACES))


def normalise_text(col) -> Column:
    """Lower, punctuation to space, collapse whitespace, strip."""
    s = F.lower(_c(col))
    s = F.regexp_replace(s, _NON_WORD, " ")
    s = F.regexp_replace(s, _SPACE_RUN, " ")
    return F.trim(s)  # only single ASCII spaces can remain at the edges


def fold_title(normalised) -> Column:
    """Plain substring synonym folds, then one pass of double-space removal."""
    s = _c(normalised)
    for old, new in TITLE_FOLDS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.trim(F.replace(s, F.lit("  "), F.lit(" ")))


def fuzzy_key(company, title) -> Column:
    """D3: ``normalise(company) + ':' + fold(normalise(title))``."""
    return F.concat(normalise_text(company), F.lit(":"), fold_title(normalise_text(title)))


def _py_str(col) -> Column:
    # f-string rendering of a missing value is 'None'
    return F.coalesce(_c(col).cast("string"), F.lit("None"))


def md5_16(text) -> Column:
    return F.substring(F.md5(_c(text)), 1, 16)


def job_id(company, title, location, given=None) -> Column:
    """The given id when non-empty, else md5(lower(company:title:location))[:16]."""
    key = F.lower(F.concat_ws(":", _py_str(company), _py_str(title), _py_str(location)))
    computed = md5_16(key)
    if given is None:
        return computed
    return F.coalesce(F.nullif(_c(given), F.lit("")), computed)


def company_id_from_name(name) -> Column:
    """md5(lower(requested name))[:16]."""
    return md5_16(F.lower(_c(name)))


def infer_website(name) -> Column:
    """Lower, strip one legal suffix, drop punctuation, remove dashes/spaces, + '.com'."""
    s = F.lower(_c(name))
    s = F.regexp_replace(s, f"[{PY_SPACE_CLASS}]+{LEGAL_SUFFIX_ALTERNATIVES}$", "")
    s = F.regexp_replace(s, f"[^{PY_WORD_CLASS}{PY_SPACE_CLASS}-]", "")
    s = F.regexp_replace(s, f"[-{PY_SPACE_CLASS}]+", "")
    return F.concat(s, F.lit(".com"))


def truncate_description(col, n: int = 200) -> Column:
    """First n characters + '...' when longer than n."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def html_teaser(col, n: int = 200) -> Column:
    """Strip tags, first n characters, always followed by '...'."""
    return F.concat(F.substring(F.regexp_replace(_c(col), "<[^>]*>", ""), 1, n), F.lit("..."))


def title_case(col) -> Column:
    """Title-case a country name; a missing value becomes ''."""
    return F.coalesce(F.initcap(_c(col)), F.lit(""))


def like_escape(q: str) -> str:
    """a search term for LIKE; '%' and '_' stay wildcards, backslash is literal."""
    return q.replace("\\", "\\\\")


def ascii_lower(col) -> Column:
    """SQLite LIKE folds ASCII letters only."""
    return F.translate(_c(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
