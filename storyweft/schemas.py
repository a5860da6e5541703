"""Schemas of the stored tables."""

from __future__ import annotations

ITEM = "id string, outlet string, url string, title string, lede string, author string, published string, fetched string, tags array<string>"
MEMBER = "struct<item_id:string,outlet:string,title:string,lede:string,published:string,url:string>"
CLUSTER = f"id string, version int, anchor string, status string, items array<{MEMBER}>, superseded_by string"
PENDING_PAIR = f"pair_id string, a {MEMBER}, b {MEMBER}, score double"
LABEL = "pair_id string, item_id_a string, item_id_b string, outlet_a string, outlet_b string, score double, same_story boolean, labeled_at string, seq long"
JUDGMENT = "pair_id string, item_id_a string, item_id_b string, same_story boolean, reason string, backend string, model string, judged_at string"
ANSWER = "pair_id string, variant string, prompt_id string, p double, model string, input_tokens int, cost double, seconds double"
RUN = (
    "date string, finished_at string, status string, started_at string, duration_seconds double, agent_seconds double, note string, "
    "counts map<string,bigint>, steps array<struct<name:string,seconds:double,ok:boolean>>"
)
GOLDEN = "cluster string, expected_discrepancies array<struct<kind:string,outlets:array<string>>>, checked boolean, source string"
BATCH = "batch_id string, cluster_versions map<string,int>"
