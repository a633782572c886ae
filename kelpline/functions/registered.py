"""Functions by name in SQL: scalar ones, and a table function over pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kelpline.functions import text

_SCRIPT = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)


@udtf(returnType="id string, title string, company string")
class JsonLdPostings:
    """json_ld_postings(html): the job postings of a page's JSON-LD, at the root, in arrays and graphs; broken scripts give none."""

    def eval(self, html: str) -> Iterator[tuple]:
        for script in _SCRIPT.findall(html or ""):
            try:
                root = json.loads(script)
            except ValueError:
                continue
            for item in root if isinstance(root, list) else [root]:
                for o in [item, *(item.get("@graph") or [])] if isinstance(item, dict) else []:
                    if isinstance(o, dict) and o.get("@type") == "JobPosting":
                        company = o.get("hiringOrganization")
                        given = o.get("identifier")
                        yield None if given is None else str(given), o.get("title"), company.get("name") if isinstance(company, dict) else None


def register(spark: SparkSession) -> None:
    """nfkc, repair_mojibake, decode_euc_kr and html_unescape as functions of SQL, and the table function json_ld_postings."""
    for fn in ("nfkc", "repair_mojibake", "decode_euc_kr", "html_unescape"):
        spark.udf.register(fn, getattr(text, fn))
    spark.udtf.register("json_ld_postings", JsonLdPostings)
