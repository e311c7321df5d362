"""Masking by dictionaries and decisions: candidates, registry lookups, numbering that goes on from a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions.text import context, nfkc, nfkc_trim
from inkveil.operators.masking import continue_placeholders
from inkveil.operators.matching import BROADCAST_NAMES, contained_phrases, longest_matches, quoted
from inkveil.sources.scratch import materialised

# Labels and what they mask as; patterns of technical terms, the rejected ones first.
CATEGORIES = {"ORG": "company", "GPE": "site", "FAC": "site", "PERSON": "person"}
REJECTED = (
    r"(?iU)^\s*Amazon\s+(?:Japan|Japan\s+G\.?K\.?|Japan\s+合同会社|\.com|Web\s+Services?(?:\s+Japan(?:\s+G\.?K\.?)?)?|Prime|Music|Echo|Kindle|Alexa|Fresh|Pay|Pharmacy|Robotics|Studios|Books|Game\s+Studios|Marketplace|Mechanical\s+Turk|Logistics)\s*$",
    r"(?iU)^\s*AWS\s+(?:Japan|Japan\s+G\.?K\.?|Summit|re:Invent|Reinvent|Loft|Innovate|Partner(?:s|\s+Network)?|Tokyo|Osaka|Singapore|Sydney|User\s+Group|UG)\s*$",
)
TECHNICAL = (
    r"(?iU)^\s*(?:Amazon|AWS)\s+[A-Za-z0-9][A-Za-z0-9 ./\-]{0,60}(?:\s+(?:メール|エンドポイント|レコード|サービス|フロー(?:ログ)?|バケット|ゲートウェイ|プロトコル|SMTP(?:\s+VPC\s+エンドポイント)?|VPC(?:\s+エンドポイント)?))?\s*$",
    r"(?iU)^\s*(?:SES|S3|EC2|VPC|VIF|VPN|SNS|SQS|IAM|RDS|EBS|ELB|ALB|NLB|KMS|ACM|WAF|CloudWatch|CloudFront|CloudTrail|CloudShell|Route\s*53|Lambda|EventBridge|GuardDuty|Config|Athena|Firehose|Backlog|AMS|Direct\s*Connect(?:\s+Gateway)?|(?:Private|Public)\s+VIF|(?:Private|Public)\s+Virtual\s+Interface|SMTP(?:S)?|IMAP|POP3|HTTP|HTTPS|TLS|SSL|SSH|FTP|SFTP|NTP|DNS|DKIM|DMARC|SPF|MX|AUTH|DomainKeys\s+Identified\s+Mail|BGP|OSPF|VRRP|HSRP|VLAN|NAT|ACL|CIDR)(?:\s+(?:AUTH|レコード|エンドポイント|プロトコル|サービス|VPC(?:\s+エンドポイント)?|SMTP(?:\s+VPC\s+エンドポイント)?))?\s*$",
    r"(?iU)^\s*(?:DMARC\d*\s*[;:]?\s*)?[a-z]{1,3}=[A-Za-z][A-Za-z0-9_\-]*\s*$",
    r"(?iU)^\s*DMARC\d*\s*[;:]?\s*[a-z]\s*$",
    r"(?U)^\s*\d+(?:\.\d+){0,3}\s+[぀-ヿ一-鿿A-Za-z][぀-ヿ一-鿿A-Za-z0-9 ]{0,30}\s*$",
    r"(?iU)^\s*(?:SLA|SLO|SLI|SOC|RPO|RTO|MFA|VPC|DNS|DC|AZ|API|CLI|UI|UX|VPN|NAT|ACL|MX|TLS|SSL|DKIM|DMARC|SPF|TCP|UDP|SES|S3)\s+[぀-ヿ一-鿿A-Za-z][぀-ヿ一-鿿A-Za-z0-9 ]{0,30}\s*$",
    r"(?U)^\s*([A-Za-z][A-Za-z0-9]{1,5})\s+\1\s*$",
    r"(?iU)^\s*[぀-ヿ一-鿿A-Za-z][぀-ヿ一-鿿A-Za-z0-9 ]{2,80}\s+(?:VPC|DNS|VPN|VIF|SES|S3|SMTP|DKIM|DMARC|SPF|MX|TLS|TCP|UDP)\s+[぀-ヿ一-鿿A-Za-z][぀-ヿ一-鿿A-Za-z0-9 ]{0,40}\s*$",
    r"(?U)^\s*[|｜][|｜　\s'`\"]*[A-Za-z0-9 ]{0,4}\s*$",
    r"(?iU)^\s*(?:AWS|GCP|OCI|Azure|Amazon|Google|Microsoft|Oracle|VPC|DC|AZ|MFA|RBAC|ABAC|SLA|SLO|SLI|SOC|RPO|RTO|API|CLI|GUI|SDK|UI|UX|CSV|TSV|TIFF|JPEG|PNG|GIF|PDF|DKIM|DMARC|SPF|MX|SMTP|IMAP|POP3|TLS|SSL|HTTPS?|TCP|UDP|ICMP|IPSec|RADIUS|LDAP|JSON|XML|YAML|JWT|OAuth2?|SAML|OIDC|JOSE|JWE|JWS|JWK|Backlog|Slack|GitHub|GitLab|Jira|PagerDuty|Datadog|Splunk|Kubernetes|Docker|Terraform|Ansible|Chef|Puppet|Linux|Windows|macOS|Ubuntu|CentOS|RHEL|Debian|Python|Java|Ruby|Go|Rust|TypeScript|JavaScript|React|Vue|Angular|Next\.?js|Nuxt|Svelte)\s*$",
    # words that may be spaced out
    r"(?U)^\s*(?:パ\s*ブ\s*リ\s*ッ\s*ク\s*ク\s*ラ\s*ウ\s*ド(?:\s*サ\s*ー?\s*ビ\s*ス)?|フ\s*ル\s*マ\s*ネ\s*ー?\s*ジ\s*ド\s*サ\s*ー?\s*ビ\s*ス|オ\s*ン\s*プ\s*レ\s*ミ\s*ス(?:\s*環\s*境)?|プ\s*ラ\s*イ\s*ベ\s*ー?\s*ト\s*サ\s*ブ\s*ネ\s*ッ\s*ト|パ\s*ブ\s*リ\s*ッ\s*ク\s*サ\s*ブ\s*ネ\s*ッ\s*ト|デ\s*フ\s*ォ\s*ル\s*ト|フ\s*ェ\s*ー?\s*ズ|用\s*途|方\s*法|検\s*証(?:\s*す\s*る)?|ラ\s*イ\s*フ\s*サ\s*イ\s*ク\s*ル(?:\s*管\s*理)?|フ\s*ロ\s*ー?\s*ロ\s*グ(?:\s*用\s*バ\s*ケ\s*ッ\s*ト)?|\d+\s*日\s*間)\s*$",
)
# End of the fixed values.


def tech_term_pattern(term: Column) -> Column:
    """rejected forms first, then any pattern of technical terms, on the normalised term."""
    t = nfkc_trim(term)
    out = F.lit(False)
    for p in TECHNICAL:
        out = out | t.rlike(p)
    no = F.lit(False)
    for p in REJECTED:
        no = no | t.rlike(p)
    return F.coalesce(~no & out & (t != ""), F.lit(False))


SEED = "customer_id string, text string, label string, canonical string, confirm boolean"


def load_seeds(spark: SparkSession, rows: DataFrame | list[dict], customer: str | None = None) -> DataFrame:
    """Seed entries, a table or a few dicts, common ones and the customer's; confirm defaults to true, entries without a text are left out."""
    if isinstance(rows, list):
        rows = spark.createDataFrame([tuple(r.get(k) for k in ("customer_id", "text", "label", "canonical", "confirm")) for r in rows], SEED)
    seeds = rows.select("customer_id", "text", "label", "canonical", F.coalesce("confirm", F.lit(True)).alias("confirm")).filter(F.coalesce("text", F.lit("")) != "")
    return seeds.filter(F.col("customer_id").isNull() | (F.col("customer_id") == customer)) if customer else seeds


def load_allow_terms(spark: SparkSession, groups: dict[str, list[str]], customer: str | None = None) -> DataFrame:
    """Terms by category, normalised and in lower case, each once."""
    data = [(customer, c, t) for c, terms in groups.items() for t in terms]
    rows = spark.createDataFrame(data, "customer_id string, category string, term string")
    return rows.select("customer_id", "category", F.lower(nfkc_trim(F.col("term"))).alias("term_norm")).filter("term_norm <> ''").dropDuplicates(["term_norm"])


def find_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """J4. docs: keys and text; phrases: text and more. One row per document and phrase in it, with start (from 0)."""
    return contained_phrases(docs, phrases).drop("end")


def seed_candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Names of the dictionary in NFKC texts: text (canonical, J3), label, start, end, source, confirmed, surfaces; one per name and label.

    A name within a longer one is not a candidate, unless it also stands alone (leftmost, then longest).
    """
    found = longest_matches(docs.withColumn("text", nfkc(F.coalesce("text", F.lit("")))), seeds)
    categories = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    found = found.withColumn("label", F.upper(F.element_at(categories, F.col("phrase_label")))).filter(F.col("label").isNotNull())
    kept = [c for c in docs.columns if c != "text"]
    name = F.coalesce(F.nullif("phrase_canonical", F.lit("")), F.col("phrase_text"))
    rows = found.select(*kept, name.alias("text"), F.col("phrase_text").alias("surface"), "label", "start", "end", F.when(F.col("phrase_confirm"), "seed_dict").otherwise("watchlist").alias("source"), F.col("phrase_confirm").alias("confirmed"))
    first = F.row_number().over(Window.partitionBy(*kept, "text", "label").orderBy("start", F.desc("end")))
    surfaces = rows.groupBy(*kept, "text", "label").agg(F.collect_set("surface").alias("surfaces"))
    return rows.withColumn("_k", first).filter("_k = 1").drop("_k", "surface").join(surfaces.hint("merge"), [*kept, "text", "label"])


def without_tech_terms(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates from outside the dictionaries lose technical terms, by list and by pattern. Each distinct text is judged once."""
    exempt = candidates.filter(F.col("source").isin("seed_dict", "watchlist"))
    others = candidates.filter(~F.col("source").isin("seed_dict", "watchlist"))
    told = materialised(others.select("text").distinct())
    listed = allowed.select(F.col("term_norm").alias("_n")).distinct().withColumn("_listed", F.lit(True))
    judged = told.withColumn("_n", F.lower(nfkc_trim(F.col("text")))).join(listed.hint("merge"), "_n", "left")
    technical = materialised(judged.filter(F.coalesce("_listed", F.lit(False)) | tech_term_pattern(F.col("text"))).select("text"))
    way = "broadcast" if technical.count() <= BROADCAST_NAMES else "merge"
    return exempt.unionByName(others.join(technical.hint(way), "text", "left_anti").select(*candidates.columns))


def registry_lookup(candidates: DataFrame, registry: DataFrame, top: int = 5) -> DataFrame:
    """For each distinct uncertain name hits and the first names that contain it; an empty name is an error."""
    names = candidates.filter(~F.col("confirmed")).select(F.trim("text").alias("text")).distinct()
    found = find_phrases(registry.select("name", F.col("name").alias("text")), names.filter("text <> ''"))
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("phrase_text").orderBy("name")))
    hits = ranked.groupBy(F.col("phrase_text").alias("text")).agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.col("name")))).alias("top_names"))
    out = names.join(hits.hint("merge"), "text", "left")
    return out.select("text", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top_names", F.array().cast("array<string>")).alias("top_names"), F.when(F.col("text") == "", "empty query").otherwise("").alias("error"))


def split_candidates(candidates: DataFrame, lookups: DataFrame, promote_errors: bool = False) -> tuple[DataFrame, DataFrame]:
    """(confirmed, uncertain); lookups that failed confirm a name if asked for."""
    rows = candidates.join(lookups.select(F.col("text").alias("_t"), "error").hint("merge"), F.trim("text") == F.col("_t"), "left").drop("_t")
    sure = F.col("confirmed") | (F.lit(promote_errors) & (F.coalesce("error", F.lit("")) != ""))
    return rows.filter(sure).drop("error"), rows.filter(~sure).drop("error")


def decide(uncertain: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("review_id", "doc_ord"), default: bool = True) -> DataFrame:
    """Mask or not; without a decision the default, which is to mask."""
    return uncertain.join(decisions.select(*keys, "text", "mask").hint("merge"), [*keys, "text"], "left").withColumn("mask", F.coalesce("mask", F.lit(default)))


def decision_progress(uncertain: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("review_id", "doc_ord")) -> DataFrame:
    """Candidates and decided ones per set."""
    rows = uncertain.join(decisions.select(*keys, "text", F.lit(True).alias("decided")).hint("merge"), [*keys, "text"], "left")
    return rows.groupBy("review_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("decided", F.lit(False))).alias("decided"))


def dictionary_mask(masked: DataFrame, ledger: DataFrame, candidates: DataFrame, decisions: DataFrame, default: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P13. masked: review_id, doc_ord, outbound_text. (documents, ledger that goes on, decision rows).

    The surface forms in the text are masked, longest first, under the number of their canonical name.
    """
    keys = ("review_id", "doc_ord")
    sure, open_ = candidates.filter("confirmed").withColumn("mask", F.lit(True)), decide(candidates.filter(~F.col("confirmed")), decisions, keys, default)
    told = sure.unionByName(open_)
    taken = told.filter("mask").withColumn("category", F.lower("label"))
    values = taken.select("review_id", "category", F.col("text").alias("value"), F.struct("doc_ord", "start").alias("first"))
    out = continue_placeholders(ledger, values)
    named = taken.join(out.select("review_id", "category", F.col("original").alias("text"), "placeholder").hint("merge"), ["review_id", "category", "text"])
    pairs = named.select(*keys, F.explode(F.array_distinct(F.concat("surfaces", F.array("text")))).alias("surface"), "placeholder")
    pairs = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct((-F.length("surface")).alias("n"), "surface", "placeholder"))).alias("_p"))
    docs = masked.join(pairs.hint("merge"), list(keys), "left")
    # one pass: an alternation of the quoted surfaces, longest first
    either = F.array_join(F.transform("_p", lambda x: quoted(x["surface"])), "|")
    names = F.map_from_entries(F.transform(F.array_distinct(F.transform("_p", lambda x: F.struct(x["surface"].alias("k"), F.lit("").alias("v")))), lambda x: F.struct(x["k"], F.get(F.filter("_p", lambda y: y["surface"] == x["k"]), F.lit(0))["placeholder"])))
    found = F.regexp_extract_all("outbound_text", either, F.lit(0))
    text = F.array_join(F.zip_with(F.split("outbound_text", either, -1), found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(F.element_at(names, b), F.lit("")))), "")
    docs = docs.withColumn("outbound_text", F.when(F.col("_p").isNotNull(), text).otherwise(F.col("outbound_text"))).drop("_p")
    logged = told.join(masked.select(*keys, F.col("outbound_text").alias("_x")).hint("merge"), list(keys)).select(*keys, F.col("text").alias("term"), "label", "source", F.when(F.col("mask"), "mask").otherwise("skip").alias("decision"), F.substring(context(F.col("_x"), F.col("text")), 1, 120).alias("context"))
    return docs, out, logged
