"""The request layer as data: routing scores, costs, token plans, health, cache and rate limits over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import cache_key as cache_key
from ..functions.scores import cases
from ..functions.text import clamp, rounded
from .folds import sequenced

# Least context by complexity, and weights of cost, capability, latency, streaming, health and JSON by policy. Fixed values.
LEAST_CONTEXT = {"low": 0, "medium": 32_000, "high": 128_000, "critical": 200_000}
WEIGHTS = {"critical": (5, 40, 10, 10, 25, 10), "high": (10, 30, 10, 10, 25, 15), "fast": (15, 5, 35, 10, 25, 10), "else": (30, 15, 15, 10, 20, 10)}
TOP_COST = 0.009
# Kinds of task: complexity, streaming, most cost, fastest first, JSON needed, temperature, raw text. Fixed values.
TASKS = {
    "text-repair": ("low", False, 0.0005, True, False, 0.1, True),
    "metadata": ("low", False, 0.001, True, True, 0.1, False),
    "formatting": ("low", False, 0.001, True, False, 0.2, True),
    "scene-analysis": ("medium", False, 0.01, False, True, 0.3, False),
    "chapter-summary": ("medium", False, 0.01, False, True, 0.3, False),
    "character-tracking": ("medium", False, 0.01, False, True, 0.2, False),
    "cinematization": ("high", True, 0.05, False, False, 0.6, True),
    "narrative-analysis": ("critical", True, 0.1, False, False, 0.4, True),
}
CHARS_PER_TOKEN = 4
TTL_MS, CACHE_SIZE = 30 * 60 * 1000, 50
UNHEALTHY_AFTER, RECOVERS_AFTER_MS = 3, 120_000
MOST_POLICIES = 1000


def bounded(df: DataFrame, most: int, what: str) -> None:
    """An error where a table that is to be sent to all tasks has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")


def tokens(t) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / float(CHARS_PER_TOKEN)))).cast("long")


def provider_scores(providers: DataFrame, policies: DataFrame, input_tokens: int = 500) -> DataFrame:
    """(policy, name, cost_usd, score, refused): six weighted scores, or why a provider is out.

    Policies are a stated set of at most MOST_POLICIES that all providers are rated for; it is sent to the providers.
    """
    bounded(policies, MOST_POLICIES, "policies")
    kind = F.when(F.col("complexity").isin("critical", "high"), F.col("complexity")).when(F.col("prefer_fastest") & (F.col("complexity") == "low"), "fast").otherwise("else")
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    least = F.create_map(*[F.lit(x) for kv in LEAST_CONTEXT.items() for x in kv])
    p = policies.select("*", kind.alias("_kind"), F.element_at(least, F.col("complexity")).alias("_least"))
    block = p.agg(F.collect_list(F.struct(*p.columns)).alias("_all"))
    rows = providers.join(F.broadcast(block)).select(*providers.columns, F.explode("_all").alias("p")).select(*providers.columns, "p.*")
    rows = rows.withColumn("_w", F.element_at(weight, F.col("_kind"))).withColumn("cost_usd", (F.lit(input_tokens) + F.col("max_tokens")) / 1000.0 * F.col("cost_per_1k"))
    critical = F.col("complexity") == "critical"
    refused = cases(
        [
            (~F.col("healthy"), "unhealthy"),
            ((F.col("cost_usd") > F.col("max_cost")) & (F.col("max_cost") > 0), "cost"),
            (F.col("needs_stream") & ~F.col("streams"), "streaming"),
            (F.col("require_json") & ~F.col("json"), "json"),
            (critical & ~F.col("top_tier"), "tier"),
        ],
        None,
    )
    parts = [
        F.greatest(F.lit(0.0), 100 - F.col("cost_per_1k") / F.lit(TOP_COST if TOP_COST > 0.01 else 0.01) * 100),
        F.least(F.lit(100.0), F.least(F.lit(1.0), F.col("context") / F.greatest(F.lit(1), F.col("_least"))) * 70 + F.when(critical & F.col("top_tier"), 30).otherwise(0)),
        F.greatest(F.lit(0.0), 100 - F.col("latency_ms") / 1000.0 * 100),
        F.when(~F.col("needs_stream"), 50).when(F.col("streams"), 100).otherwise(0),
        F.when(F.col("healthy"), 100).otherwise(0),
        F.when(~F.col("require_json"), 50).when(F.col("json"), 100).otherwise(0),
    ]
    total, weights = parts[0] * F.get("_w", F.lit(0)), F.get("_w", F.lit(0))
    for i in range(1, 6):
        total, weights = total + parts[i] * F.get("_w", F.lit(i)), weights + F.get("_w", F.lit(i))
    return rows.select("policy", "name", "cost_usd", F.when(refused.isNull(), rounded(total / weights, 2)).otherwise(0.0).alias("score"), refused.alias("refused"))


def task_policies(spark: SparkSession) -> DataFrame:
    """The kinds of task as policies, with temperature and whether the answer is raw text."""
    return spark.createDataFrame([(name, *row) for name, row in TASKS.items()], "policy string, complexity string, needs_stream boolean, max_cost double, prefer_fastest boolean, require_json boolean, temperature double, raw_text boolean")


def routes(scores: DataFrame) -> DataFrame:
    """(policy, provider, chain): the best provider for each policy, and all that are left in order."""
    at = Window.partitionBy("policy").orderBy(F.desc("score"), "name")
    ranked = scores.filter("refused is null").withColumn("_n", F.row_number().over(at))
    return ranked.groupBy("policy").agg(F.min_by("name", "_n").alias("provider"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ">").alias("chain"))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with cost_usd, by a price table (provider, per 1k tokens). Whether the table is sent or shuffled is left to its size."""
    return calls.join(prices, calls["provider"] == prices["name"], "left").withColumn("cost_usd", F.col("tokens") / 1000.0 * F.coalesce("cost_per_1k", F.lit(0.0)))


def health(calls: DataFrame, key: str = "provider") -> DataFrame:
    """(provider, calls, failures, longest_run, last_run, healthy): runs of failures in a row."""
    at = Window.partitionBy(key).orderBy("ts")
    rows = calls.select(key, "ts", "ok").withColumn("_run", F.sum(F.col("ok").cast("int")).over(at))
    runs = rows.filter(~F.col("ok")).groupBy(key, "_run").agg(F.count("*").alias("n"), F.max("ts").alias("until"))
    longest = runs.groupBy(key).agg(F.max("n").alias("longest_run"))
    total = rows.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.max("_run").alias("_last"))
    last = total.join(runs.withColumnRenamed("_run", "_last").select(key, "_last", F.col("n").alias("last_run")), [key, "_last"], "left").join(longest, key, "left").fillna(0, ["last_run", "longest_run"])
    return last.select(key, "calls", "failures", "longest_run", "last_run", (F.col("last_run") < UNHEALTHY_AFTER).alias("healthy"))


def usable(calls: DataFrame, now: int, key: str = "provider") -> DataFrame:
    """(provider, usable): healthy providers, and those not called for RECOVERS_AFTER_MS, which are worth another try."""
    last = calls.groupBy(key).agg(F.max("ts").alias("_ts"))
    return health(calls, key).join(last, key).select(key, (F.col("healthy") | (F.lit(now) - F.col("_ts") > RECOVERS_AFTER_MS)).alias("usable"))


def cache_events(requests: DataFrame, ttl: int = TTL_MS, size: int = CACHE_SIZE) -> DataFrame:
    """(provider, request, prompt, ts, outcome, evicted) of a cache a provider: hit, miss, or expired.

    An entry lives for ``ttl`` from when it was stored; hits do not renew it. A request that is no hit and succeeds
    stores its answer, and where ``size`` entries are held already, the one used longest ago is evicted for it.
    """

    def step(cache: dict, r: dict):
        made, evicted = cache.get(r["prompt"]), None
        outcome = "miss" if made is None else "expired" if r["ts"] - made > ttl else "hit"
        # a dict keeps the order of use: what is used goes to its end
        if outcome != "miss":
            del cache[r["prompt"]]
        if outcome == "hit":
            cache[r["prompt"]] = made
        elif r["ok"]:
            if len(cache) >= size:
                evicted = next(iter(cache))
                del cache[evicted]
            cache[r["prompt"]] = r["ts"]
        return cache, [(r["request"], r["prompt"], r["ts"], outcome, evicted)]

    rows = requests.select("provider", "request", "prompt", "ts", "ok")
    return sequenced(rows, ["provider"], ["ts", "request"], dict, step, "request string, prompt string, ts long, outcome string, evicted string")


def cache_statistics(requests: DataFrame, ttl: int = TTL_MS, size: int = CACHE_SIZE) -> DataFrame:
    """(provider, hits, misses, expirations, evictions, hit_rate): what expires is a miss and an eviction too."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    seen = cache_events(requests, ttl, size).groupBy("provider").agg(of("hit").alias("hits"), of("miss", "expired").alias("misses"), of("expired").alias("expirations"), (F.count("evicted") + of("expired")).alias("evictions"))
    return seen.withColumn("hit_rate", rounded(F.col("hits") / (F.col("hits") + F.col("misses")), 3))


def least_recent(requests: DataFrame, keep: int = CACHE_SIZE) -> DataFrame:
    """(provider, prompt, last_ts) of the ``keep`` entries used last; what stays in a cache of that size."""
    last = requests.groupBy("provider", "prompt").agg(F.max("ts").alias("last_ts"))
    return last.orderBy(F.desc("last_ts"), "provider", "prompt").limit(keep)


def deduplicated(requests: DataFrame, within: int = 5_000) -> DataFrame:
    """(provider, prompt, request, ts) of the requests that are executed: those not made while an equal one is in flight.

    A request is in flight for ``within`` from when it was executed; those that join it do not prolong that.
    """
    step = lambda until, r: (until, []) if until is not None and r["ts"] <= until else (r["ts"] + within, [(r["request"], r["ts"])])
    return sequenced(requests.select("provider", "prompt", "request", "ts"), ["provider", "prompt"], ["ts", "request"], lambda: None, step, "request string, ts long")


def first_success(requests: DataFrame) -> DataFrame:
    """(prompt, attempts, provider): the provider of the first call that succeeded, and the calls up to it."""
    at = Window.partitionBy("prompt").orderBy("ts", "request")
    rows = requests.withColumn("_n", F.row_number().over(at))
    done = rows.groupBy("prompt").agg(F.min(F.when(F.col("ok"), F.struct("_n", "provider"))).alias("d"), F.count("*").alias("all"))
    return done.select("prompt", F.coalesce("d._n", F.col("all")).cast("long").alias("attempts"), "d.provider")


def token_buckets(requests: DataFrame, rpm: int = 60, tpm: int = 60_000, key: str = "provider") -> DataFrame:
    """(provider, request, wait_ms): what each request waits for in a bucket of requests and one of tokens.

    Buckets hold ten seconds' worth and refill evenly; later requests wait behind earlier ones.
    """
    most_requests, most_tokens = float(max(1, -(-rpm // 6))), float(max(1, -(-tpm // 6)))
    per_request, per_token = rpm / 60_000.0, tpm / 60_000.0

    def step(state: tuple, row: dict):
        r, t, at = state
        now = max(float(row["ts"]), at)
        r, t = min(most_requests, r + (now - at) * per_request), min(most_tokens, t + (now - at) * per_token)
        need = min(float(row["tokens"]), most_tokens)
        wait = max(0.0, (1 - r) / per_request, (need - t) / per_token)
        left = (min(most_requests, r + wait * per_request) - 1.0, min(most_tokens, t + wait * per_token) - need, now + wait)
        return left, [(row["request"], now + wait - row["ts"])]

    rows = requests.select(key, "ts", "request", "tokens")
    waits = sequenced(rows, [key], ["ts", "request", "tokens"], lambda: (most_requests, most_tokens, 0.0), step, "request string, wait_ms double")
    return waits.withColumn("wait_ms", rounded("wait_ms", 3))


def trimmed_prompt(prompt, budget: int) -> Column:
    """A prompt within a token budget: its first fifth, a mark, and its end."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    most = budget * CHARS_PER_TOKEN
    lead = int(most * 0.2)
    tail = max(0, most - lead - 48)
    cut = F.concat(F.substring(p, 1, lead), F.lit("\n\n...[prompt truncated to fit token budget]...\n\n"), F.substring(p, F.greatest(F.lit(1), F.length(p) - tail + 1), F.lit(tail)))
    return F.lit("") if budget <= 0 else F.when(F.length(p) <= most, p).otherwise(cut)


def token_plan(rows: DataFrame, context: int = 8_000, wanted: int = 1_024, system_tokens: int = 50, prompt: str = "text") -> DataFrame:
    """Adds prompt_tokens, output_tokens and fits: how a context window is shared."""
    t = tokens(prompt)
    room = F.greatest(F.lit(0), F.lit(context - system_tokens - 8) - t)
    return rows.withColumn("prompt_tokens", t).withColumn("output_tokens", F.least(F.lit(wanted), room)).withColumn("fits", F.col("output_tokens") >= wanted)


def error_kind(message) -> Column:
    """The kind of a failure by the first phrase its message holds."""
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    has = lambda *words: F.regexp_like(m, F.lit("|".join(words)))
    return cases([(has("429", "rate limit", "too many requests"), "rate_limit"), (has("401", "403", "unauthorized", "api key"), "auth"), (has("timeout", "timed out"), "timeout"), (has("network", "fetch", "connection"), "network"), (has("404", "model not found", "unavailable"), "model_unavailable")], "unknown")


def retry_delay(attempt, base: int = 1000, cap: int = 30_000, after=None, spread: float = 0.0, seed=None) -> Column:
    """Milliseconds before a further attempt: doubled each time, up to the cap; what the server asked for goes before.

    With ``spread``, delays are stretched by up to that share, by a digest of ``seed``, so that reruns agree.
    """
    wait = base * F.pow(F.lit(2.0), F.col(attempt))
    if spread:
        wait = wait * (1 + spread * F.pmod(F.xxhash64(seed), F.lit(1000)) / 1000.0)
    wait = F.least(F.lit(float(cap)), wait)
    return (wait if after is None else F.coalesce(F.col(after).cast("double"), wait)).cast("long")


def dated_costs(calls: DataFrame, prices: DataFrame, width: int = 86_400_000) -> DataFrame:
    """(provider, calls, unpriced, estimated_usd, actual_usd): each call at the price of its time, and at the newest one.

    Calls (provider, ts, estimated, tokens) meet prices (provider, since, micros: millionths a thousand tokens) as of their time by
    one sort of both together. A provider's time is cut in stretches of ``width``, which are sorted apart, so one with most of the
    calls is many tasks' work; the price in force when a stretch begins comes from the prices and the stretches alone. Of prices
    of one time the highest holds. Sums are whole numbers, so their order does not matter.
    """
    stretch = lambda c: F.floor(F.col(c) / width).cast("long")
    priced = prices.filter("since is not null and micros is not null").groupBy("provider", "since").agg(F.max("micros").cast("long").alias("micros"))
    rows = calls.select("provider", "ts", F.coalesce("estimated", F.lit(0)).cast("long").alias("estimated"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    none = lambda name: F.lit(None).cast("long").alias(name)
    # a row a stretch, at its start, and the prices: what was in force before
    starts = rows.select("provider", stretch("ts").alias("part")).distinct().select("provider", (F.col("part") * width).alias("ts"), F.lit(1).alias("_start"), none("micros"))
    known = starts.unionByName(priced.select("provider", F.col("since").alias("ts"), F.lit(0).alias("_start"), "micros"))
    before = Window.partitionBy("provider").orderBy("ts", "_start").rowsBetween(Window.unboundedPreceding, 0)
    carried = known.withColumn("micros", F.last("micros", ignorenulls=True).over(before)).filter("_start = 1 and micros is not null")
    both = (
        rows.select("provider", "ts", F.lit(1).alias("_call"), none("micros"), "estimated", "tokens")
        .unionByName(priced.select("provider", F.col("since").alias("ts"), F.lit(0).alias("_call"), "micros", none("estimated"), none("tokens")))
        .unionByName(carried.select("provider", "ts", F.lit(-1).alias("_call"), "micros", none("estimated"), none("tokens")))
    )
    at = Window.partitionBy("provider", "_part").orderBy("ts", "_call").rowsBetween(Window.unboundedPreceding, 0)
    then = both.withColumn("_part", stretch("ts")).withColumn("micros", F.last("micros", ignorenulls=True).over(at)).filter("_call = 1")
    sums = then.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(F.col("micros").isNull()).alias("unpriced"), F.coalesce(F.sum(F.col("tokens") * F.col("micros")), F.lit(0)).alias("_actual"), F.sum("estimated").alias("_estimated"))
    newest = priced.groupBy("provider").agg(F.max_by("micros", "since").alias("_newest"))
    usd = lambda x: x.cast("double") / 1e9
    return sums.join(newest, "provider", "left").select("provider", "calls", "unpriced", usd(F.col("_estimated") * F.coalesce("_newest", F.lit(0))).alias("estimated_usd"), usd(F.col("_actual")).alias("actual_usd"))
