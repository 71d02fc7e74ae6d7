"""Raw mail messages: headers in any encoding, parts in any transfer encoding."""
from __future__ import annotations

import email
import email.parser
import email.policy

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quern.functions import text as T

PARTS = StructType([*(StructField(n, StringType()) for n in ("subject", "sender", "msg_id", "plain", "html")), StructField("attachments", IntegerType())])


def _text(part) -> str | None:
    """A part's text; one in an unknown character set is read as UTF-8 with marks for what is not."""
    data = part.get_payload(decode=True)
    if data is None:
        return None
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _parts(raw: str | None) -> tuple:
    if not raw or not raw.strip():
        return (None,) * 5 + (0,)
    m = email.message_from_string(raw, policy=email.policy.default)
    first: dict[str, str | None] = {}
    attachments = 0
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attachments += 1
        elif part.get_content_type() in ("text/plain", "text/html"):
            first.setdefault(part.get_content_type(), _text(part))
    header = lambda name: None if m[name] is None else str(m[name])
    return header("subject"), header("from"), header("message-id"), first.get("text/plain"), first.get("text/html"), attachments


@F.pandas_udf(StringType())
def _subject(raw: pd.Series) -> pd.Series:
    """The subjects alone: the parts of a message aren't looked at."""
    heads = [email.parser.HeaderParser(policy=email.policy.default).parsestr(r) if r and r.strip() else {} for r in raw]
    return pd.Series([None if m.get("subject") is None else str(m["subject"]) for m in heads], dtype=object)


@F.pandas_udf(PARTS)
def _parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parts(r) for r in raw], columns=PARTS.names)


def messages(raw: DataFrame, column: str, keyword: str | None = None) -> DataFrame:
    """``raw`` with the decoded subject, sender, msg_id, plain and html parts and the number of attachments in place of ``column``;
    with a ``keyword`` only messages whose subject holds it, in any case, and only these are taken apart. Null and blank messages have no parts."""
    if keyword is not None:
        raw = raw.withColumn("_s", _subject(F.col(column))).filter(F.lower("_s").contains(keyword.lower())).drop("_s")
    return raw.withColumn("_m", _parsed(F.col(column))).select(*[c for c in raw.columns if c != column], "_m.*")


def body_text(plain: Column, html: Column) -> Column:
    """The text of a message: the plain part, or the html part without its markup."""
    return F.coalesce(F.nullif(F.trim(plain), F.lit("")), T.html_to_text(html))
