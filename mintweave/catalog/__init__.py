"""All named queries.  Importing this package registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave.catalog import flows, funding, graph, ingest, scoring, store, tape, wallets  # noqa: F401
from mintweave.catalog.registry import ORACLES, QUERIES, query
from mintweave.catalog.tape import DAY_WINDOWS, EARLY, FIRST, _window_sql
from mintweave.operators import execution as X
from mintweave.operators import tape as T
from mintweave.sources import bindings as B

__all__ = ["ORACLES", "QUERIES", "flagship"]


@query("early_buyers_report", "tape_l", "launches", sql=f"""WITH {FIRST}, {EARLY},
fb AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL}) AS position FROM first_buys),
wc AS ({_window_sql(DAY_WINDOWS)}), e AS (SELECT * FROM early WHERE position <= 100),
s AS (SELECT DISTINCT mint, fee_payer AS g, wallet FROM e WHERE fee_payer <> wallet), a AS (SELECT DISTINCT mint, signature AS g, wallet FROM e),
l AS (SELECT mint, wallet FROM s WHERE (mint, g) IN (SELECT (mint, g) FROM s GROUP BY mint, g HAVING count(*) >= 2)
 UNION SELECT mint, wallet FROM a WHERE (mint, g) IN (SELECT (mint, g) FROM a GROUP BY mint, g HAVING count(*) >= 2))
SELECT mint, wallet, position::INT AS position, ultra_early, early, launch, extended, wc.full, (mint, wallet) IN (SELECT (mint, wallet) FROM l) AS linked
FROM fb JOIN wc USING (mint) WHERE position <= 50""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """First 50 buyers of every launch, the launch's window counts, and who shares a signer or transaction."""
    tape, made = B.tape_l(spark, sf), B.launches(spark, sf)
    buyers = T.first_buyers(tape, 50).select("mint", "wallet", "position")
    linked = X.linked_wallets(tape).withColumn("linked", F.lit(True))
    out = buyers.join(T.window_counts(tape, made, DAY_WINDOWS), "mint").join(linked, ["mint", "wallet"], "left")
    return out.withColumn("linked", F.coalesce("linked", F.lit(False)))
