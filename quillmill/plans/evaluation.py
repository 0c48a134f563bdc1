"""Queries over rewards, rollouts, evaluation records and scaling laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import rewards as R
from quillmill.functions.arrays import lr_cosine
from quillmill.functions.text import PROMPTS, format_prompt
from quillmill.operators import evaluation as E
from quillmill.operators import scaling as S
from quillmill.plans.registry import Catalog

query = Catalog()

# deterministic rollouts: an answer is the conversation's number modulo 5, right if it equals the turn modulo 5
_ROLLOUT = """SELECT conv_id, turn, role, text, conv_id % 5 AS given, turn % 5 AS truth,
 CASE WHEN conv_id % 3 = 0 THEN text ELSE '<think> ' || text || CASE WHEN conv_id % 7 = 1 THEN '</think><answer> ' ELSE '</think> <answer> ' END || (conv_id % 5) || ' </answer>' END AS response FROM conversations WHERE role <> 'system'"""
_SCORED = f"""SELECT *, CASE WHEN contains(response, '</think> <answer>') AND contains(response, '</answer>') THEN 1.0 ELSE 0.0 END::DOUBLE AS format_reward,
 CASE WHEN contains(response, '</think> <answer>') AND contains(response, '</answer>') AND given = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS answer_reward FROM ({_ROLLOUT})"""


def _rollouts(conversations):
    given, truth = F.col("conv_id") % 5, F.col("turn") % 5
    middle = F.when(F.col("conv_id") % 7 == 1, "</think><answer> ").otherwise("</think> <answer> ")
    tagged = F.concat(F.lit("<think> "), "text", middle, given.cast("string"), F.lit(" </answer>"))
    return conversations.where("role <> 'system'").select("conv_id", "turn", "role", "text", given.alias("given"), truth.alias("truth"), F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(tagged).alias("response"))


def _scored(conversations):
    ok = R.format_ok(F.col("response"))
    right = ok & (F.trim(R.answer_tag(F.col("response"))) == F.col("truth").cast("string"))
    rows = _rollouts(conversations)
    return rows.withColumns({"format_reward": ok.cast("double"), "answer_reward": right.cast("double"), "reward": right.cast("double")})


@query("answer_extract", "conversations", sql=rf"SELECT conv_id, turn, regexp_extract(response, '(?is)<answer>\s*(.*?)\s*</answer>', 1) AS answer FROM ({_ROLLOUT})")
def answer_extract(conversations):
    return _rollouts(conversations).select("conv_id", "turn", R.answer_tag(F.col("response")).alias("answer"))


@query("gsm8k_last_number", "documents", sql=r"""
SELECT doc_id, replace(regexp_extract_all(text, '-?\d+(?:,\d{3})*(?:\.\d+)?')[-1], ',', '') AS number FROM documents""")
def gsm8k_last_number(docs):
    return docs.select("doc_id", R.last_number(F.col("text")).alias("number"))


@query("gsm8k_gold", "conversations", sql=r"SELECT conv_id, turn, (conv_id * 1000 + turn)::VARCHAR AS gold FROM conversations")
def gsm8k_gold(conversations):
    solution = F.concat("text", F.lit("\n#### "), F.format_number(F.col("conv_id") * 1000 + F.col("turn"), 0))
    return conversations.select("conv_id", "turn", R.gsm8k_gold(solution).alias("gold"))


@query("mmlu_letter", "conversations", sql="SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE chr((65 + conv_id % 4)::INTEGER) END AS letter FROM conversations")
def mmlu_letter(conversations):
    letter = F.chr(F.lit(65) + F.col("conv_id") % 4)
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("The correct answer is "), letter, F.lit("."))).when(F.col("turn") % 4 == 1, F.concat(letter, F.lit(") yes"))).when(F.col("turn") % 4 == 2, letter).otherwise("nothing to see")
    return conversations.select("conv_id", "turn", R.mmlu_letter(said).alias("letter"))


@query("eval_contingency", "conversations", sql=f"""
WITH c AS (SELECT (format_reward >= 0.5)::INTEGER AS format_ok, (answer_reward >= 0.5)::INTEGER AS answer_ok, count(*) AS n FROM ({_SCORED}) GROUP BY ALL),
k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(format_ok, answer_ok))
SELECT k.format_ok, k.answer_ok, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN c USING (format_ok, answer_ok)""")
def eval_contingency(conversations):
    return E.contingency(_scored(conversations))


@query("eval_metrics", "conversations", sql=f"SELECT count(*)::BIGINT AS n, round(avg(format_reward), 6) AS format_rate, round(avg(answer_reward), 6) AS answer_accuracy, round(avg(answer_reward), 6) AS reward_mean FROM ({_SCORED})")
def eval_metrics(conversations):
    m = E.eval_metrics(_scored(conversations))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("correctness_filter", "conversations", sql=f"SELECT conv_id, turn FROM ({_SCORED}) WHERE answer_reward = 1.0")
def correctness_filter(conversations):
    return _scored(conversations).where("answer_reward = 1.0").select("conv_id", "turn")


@query("graded_rewards", "conversations", sql=f"SELECT conv_id, turn, format_reward, answer_reward, answer_reward AS reward FROM ({_SCORED})")
def graded_rewards(conversations):
    rows = _rollouts(conversations).withColumn("r", R.think_answer_reward("response", F.col("truth").cast("string")))
    return rows.select("conv_id", "turn", "r.*")


_LENGTHS = "SELECT user_id AS group_id, event_id, value AS reward FROM events"


@query("group_advantages", "events", sql=f"""SELECT event_id, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-6), 5) AS advantage FROM ({_LENGTHS}) WINDOW w AS (PARTITION BY group_id)""")
def group_advantages(events):
    rows = events.select(F.col("user_id").alias("group_id"), "event_id", F.col("value").alias("reward"))
    return E.group_advantages(rows).select("event_id", F.round("advantage", 5).alias("advantage"))


@query("group_reward_metadata", "events", sql=f"""
WITH g AS (SELECT avg(reward) AS m, stddev_pop(reward) AS s, stddev_samp(reward) AS ss FROM ({_LENGTHS}) GROUP BY group_id)
SELECT (SELECT round(avg(reward), 5) FROM ({_LENGTHS})) AS reward_mean, (SELECT round(stddev_pop(reward), 5) FROM ({_LENGTHS})) AS reward_std, (SELECT min(reward) FROM ({_LENGTHS})) AS reward_min,
 (SELECT max(reward) FROM ({_LENGTHS})) AS reward_max, round(avg(m), 5) AS group_mean_mean, round(stddev_pop(m), 5) AS group_mean_std, round(avg(s), 5) AS group_std_mean,
 count(CASE WHEN ss = 0 THEN 1 END)::BIGINT AS zero_std_groups, count(*)::BIGINT AS n_groups FROM g""")
def group_reward_metadata(events):
    m = E.reward_metadata(events.select(F.col("user_id").alias("group_id"), F.col("value").alias("reward")))
    exact = {"reward_min", "reward_max", "zero_std_groups", "n_groups"}
    return m.select(*[F.col(c) if c in exact else F.round(c, 5).alias(c) for c in m.columns])


@query("generation_stats", "conversations", sql=f"""SELECT count(*)::BIGINT AS n, count(CASE WHEN answer_reward > 0 THEN 1 END)::BIGINT AS n_correct, count(CASE WHEN answer_reward = 0 THEN 1 END)::BIGINT AS n_incorrect,
 round(avg(length(response)), 6) AS avg_length, round(avg(CASE WHEN answer_reward > 0 THEN length(response) END), 6) AS avg_length_correct, round(avg(CASE WHEN answer_reward = 0 THEN length(response) END), 6) AS avg_length_incorrect,
 round(avg(CASE WHEN turn % 2 = 0 THEN turn / 10.0 END)::DOUBLE, 6) AS avg_entropy FROM ({_SCORED})""")
def generation_stats(conversations):
    entropy = F.when(F.col("turn") % 2 == 0, F.col("turn") / 10.0).otherwise(F.lit(float("nan")))
    right = E.correctness(F.lit(None).cast("boolean"), F.col("answer_reward"), F.col("response"), F.col("truth").cast("string"))
    m = E.generation_stats(_scored(conversations).select(F.length("response").alias("length"), right.alias("is_correct"), entropy.alias("entropy")))
    return m.select("n", "n_correct", "n_incorrect", *[F.round(c, 6).alias(c) for c in m.columns[3:]])


_LOGP = "SELECT event_id, user_id, value, -1.0 - (event_id % 7) / 10.0::DOUBLE AS logp, -1.0 - (event_id % 5) / 10.0::DOUBLE AS old, (value - 50) / 50.0::DOUBLE AS adv, (event_id % 3 > 0)::INTEGER AS mask FROM events"


def _log_probs(events):
    return events.select("event_id", "user_id", "value", (F.lit(-1.0) - F.col("event_id") % 7 / 10.0).alias("logp"), (F.lit(-1.0) - F.col("event_id") % 5 / 10.0).alias("old"), ((F.col("value") - 50) / 50.0).alias("adv"), (F.col("event_id") % 3 > 0).cast("int").alias("mask"))


@query("grpo_clip_loss", "events", sql=f"SELECT event_id, round(-least(exp(logp - old) * adv, greatest(least(exp(logp - old), 1.2), 0.8) * adv), 6) AS loss, greatest(least(exp(logp - old), 1.2), 0.8) * adv < exp(logp - old) * adv AS clipped FROM ({_LOGP})")
def grpo_clip_loss(events):
    x = _log_probs(events)
    return x.select("event_id", F.round(R.policy_gradient_loss("grpo_clip", F.col("logp"), F.col("old"), F.col("adv")), 6).alias("loss"), R.is_clipped(F.col("logp"), F.col("old"), F.col("adv")).alias("clipped"))


@query("policy_gradient_loss", "events", sql=f"SELECT event_id, round(-adv * logp, 6) AS naive, round(-exp(logp - old) * adv, 6) AS no_clip FROM ({_LOGP})")
def policy_gradient_loss(events):
    x = _log_probs(events)
    return x.select("event_id", F.round(R.policy_gradient_loss("no_baseline", F.col("logp"), advantage=F.col("adv")), 6).alias("naive"), F.round(R.policy_gradient_loss("grpo_no_clip", F.col("logp"), F.col("old"), F.col("adv")), 6).alias("no_clip"))


@query("microbatch_loss", "events", sql=f"""WITH r AS (SELECT user_id, sum(-adv * logp * mask) / nullif(sum(mask), 0) AS x FROM ({_LOGP}) GROUP BY user_id) SELECT round(avg(x) / 4, 6) AS loss FROM r""")
def microbatch_loss(events):
    rows = _log_probs(events).select(F.col("user_id").alias("row_id"), (-F.col("adv") * F.col("logp")).alias("loss"), "mask")
    return E.microbatch_loss(rows, 4).select(F.round("loss", 6).alias("loss"))


@query("masked_mean_rows", "events", sql=f"SELECT user_id, round(sum(value * mask) / nullif(sum(mask), 0), 6) AS mean, round(sum(value * mask) / 1024, 6) AS normalized FROM ({_LOGP}) GROUP BY user_id")
def masked_mean_rows(events):
    total = F.sum(F.col("value") * F.col("mask"))
    return _log_probs(events).groupBy("user_id").agg(F.round(F.try_divide(total, F.sum("mask")), 6).alias("mean"), F.round(total / 1024, 6).alias("normalized"))


@query("dpo_loss", "events", sql="SELECT event_id, round(ln(1 + exp(-0.1 * ((value - 40) - (value / 2 - 30)))), 6) AS loss FROM events")
def dpo_loss(events):
    return events.select("event_id", F.round(R.dpo_loss(F.col("value"), F.col("value") / 2, F.lit(40.0), F.lit(30.0), 0.1), 6).alias("loss"))


_R1 = PROMPTS["r1_zero"].replace("'", "''")


@query("prompt_format", "conversations", sql=rf"SELECT conv_id, turn, md5(replace('{_R1}', '{{question}}', regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS prompt_md5 FROM conversations WHERE role = 'user'")
def prompt_format(conversations):
    return conversations.where("role = 'user'").select("conv_id", "turn", F.md5(format_prompt(PROMPTS["r1_zero"], F.col("text"))).alias("prompt_md5"))


@query("chat_flatten", "conversations", sql="SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS chat_md5 FROM conversations GROUP BY conv_id")
def chat_flatten(conversations):
    turns = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return turns.select("conv_id", "n", F.md5(F.array_join(lines, "\n")).alias("chat_md5"))


@query("judge_prompt", "conversations", sql="""SELECT u.conv_id, u.turn, md5('User Message: ' || u.text || chr(10) || 'Assistant Response: ' || a.text) AS prompt_md5
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def judge_prompt(conversations):
    user = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    reply = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.concat(F.lit("User Message: "), "u", F.lit("\nAssistant Response: "), "a")).alias("prompt_md5"))


@query("safety_mean", "conversations", sql="SELECT round(avg(CASE WHEN starts_with(lower(ltrim(CASE WHEN conv_id % 4 = 0 THEN ' TRUE: ' ELSE '' END || text)), 'true') THEN 0 ELSE 1 END), 6) AS safe FROM conversations WHERE role = 'assistant'")
def safety_mean(conversations):
    said = F.concat(F.when(F.col("conv_id") % 4 == 0, " TRUE: ").otherwise(""), "text")
    return conversations.where("role = 'assistant'").agg(F.round(F.avg(R.safe(said)), 6).alias("safe"))


@query("generations_table", "conversations", sql="""SELECT p.conv_id, p.turn, substring(p.text, 1, 100) || '...' AS prompt, substring(g.text, 1, 100) || '...' AS generation
 FROM conversations p LEFT JOIN conversations g ON g.conv_id = p.conv_id AND g.turn = p.turn + 1 AND g.role = 'assistant' WHERE p.role = 'user' ORDER BY 1, 2 LIMIT 20""")
def generations_table(conversations):
    """The first prompts, each with what was answered."""
    said = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    first = conversations.where("role = 'user'").orderBy("conv_id", "turn").limit(20)
    short = lambda c: F.concat(F.substring(c, 1, 100), F.lit("..."))
    return first.join(said, ["conv_id", "turn"], "left").select("conv_id", "turn", short("text").alias("prompt"), short("answer").alias("generation"))


# -- scaling laws -------------------------------------------------------------------------------

# an order stands for a run: its customer gives the budget, its number the parameters, and the loss is least at a number that grows with the budget
_RUNS = """(SELECT pow(10.0, 18 + o_custkey % 7) AS compute_budget, CAST(1000000 * (1 + o_orderkey % 500) * (1 + o_custkey % 7) AS BIGINT) AS parameters,
 round(2 + abs(o_orderkey % 500 - 40 * (1 + o_custkey % 7)) / 100.0 + CAST(o_totalprice AS DOUBLE) / 1e8, 9) AS final_loss FROM orders) r"""


def _runs(orders):
    k, budget = F.col("o_orderkey") % 500, F.col("o_custkey") % 7
    loss = 2 + F.abs(k - 40 * (1 + budget)) / 100.0 + F.col("o_totalprice").cast("double") / 1e8
    return orders.select(F.pow(F.lit(10.0), 18 + budget).alias("compute_budget"), (1_000_000 * (1 + k) * (1 + budget)).cast("long").alias("parameters"), F.round(loss, 9).alias("final_loss"))


_BEST = f"SELECT compute_budget::DOUBLE AS compute_budget, arg_min(parameters, (final_loss, parameters))::BIGINT AS n_opt, min(final_loss)::DOUBLE AS loss FROM {_RUNS} GROUP BY 1"


@query("isoflops_argmin", "orders", sql=f"SELECT round(log10(compute_budget), 6) AS log_c, n_opt, round(loss, 6) AS loss, round(log10(compute_budget / (6.0 * n_opt)), 6) AS log_d FROM ({_BEST})")
def isoflops_argmin(orders):
    best = S.best_runs(_runs(orders))
    return best.select(F.round(F.log10("compute_budget"), 6).alias("log_c"), "n_opt", F.round("loss", 6).alias("loss"), F.round(F.log10("d_opt"), 6).alias("log_d"))


@query("power_law_fit", "orders", sql=f"SELECT round(regr_slope(ln(n_opt), ln(compute_budget)), 6) AS a, round(regr_intercept(ln(n_opt), ln(compute_budget)), 6) AS ln_k FROM ({_BEST})")
def power_law_fit(orders):
    fit = S.power_law_fit(S.best_runs(_runs(orders)), "compute_budget", "n_opt")
    return fit.select(F.round("a", 6).alias("a"), F.round(F.log("k"), 6).alias("ln_k"))


@query("power_law_predict", "orders", sql=f"""WITH f AS (SELECT regr_slope(ln(n_opt), ln(compute_budget)) AS a, regr_intercept(ln(n_opt), ln(compute_budget)) AS k FROM ({_BEST}))
SELECT o_orderkey, round(k + a * ln(o_totalprice::DOUBLE * 1e18), 6) AS ln_n FROM orders, f""")
def power_law_predict(orders):
    """What the fit foretells for a budget after each order's price."""
    fit = F.broadcast(S.power_law_fit(S.best_runs(_runs(orders)), "compute_budget", "n_opt"))  # one row
    wanted = orders.select("o_orderkey", (F.col("o_totalprice").cast("double") * 1e18).alias("c")).join(fit)
    return wanted.select("o_orderkey", F.round(F.log(S.power_law(F.col("k"), F.col("a"), F.col("c"))), 6).alias("ln_n"))


@query("logspace_grid", "orders", sql="""SELECT i, round(2 + i * (4.0 / 299), 6) AS log_c, count(*)::BIGINT AS n FROM (SELECT floor((log10(o_totalprice::DOUBLE) - 2) / (4.0 / 299))::BIGINT AS i FROM orders WHERE o_totalprice >= 100) WHERE i < 300 GROUP BY i""")
def logspace_grid(orders):
    """Prices counted between the points of a grid that is even in their logarithm."""
    grid = S.logspace(orders.sparkSession, 2, 6, 300).select("i", F.round(F.log10("c"), 6).alias("log_c"))
    at = F.floor((F.log10(F.col("o_totalprice").cast("double")) - 2) / (4.0 / 299))
    return orders.where("o_totalprice >= 100").groupBy(at.alias("i")).agg(F.count("*").alias("n")).join(F.broadcast(grid), "i").select("i", "log_c", "n")


@query("lr_cosine", "documents", sql="""SELECT doc_id, round(CASE WHEN doc_id < 100 THEN doc_id / 100.0 * 1e-3 WHEN doc_id > 900 THEN 1e-4
 ELSE 1e-4 + 0.5 * (1 + cos((doc_id - 100) / 800.0 * pi())) * (1e-3 - 1e-4) END::DOUBLE, 9) AS lr FROM documents""")
def lr_schedule(docs):
    """The rate of the step that trains on each document, taken in order of their ids."""
    return docs.select("doc_id", F.round(lr_cosine(F.col("doc_id"), 1e-3, 1e-4, 100, 900), 9).alias("lr"))


@query("sweep_grid", "documents", sql="""SELECT source, lr, batch, ceil(n / batch)::BIGINT AS steps FROM (SELECT source, count(*) AS n FROM documents GROUP BY source),
 (VALUES (1e-3::DOUBLE), (1e-4::DOUBLE)) a(lr), (VALUES (8), (16), (32)) b(batch)""")
def sweep_grid(docs):
    """Every setting of a sweep for each source, with the steps that one pass over its documents takes."""
    sources = docs.groupBy("source").agg(F.count("*").alias("n"))
    sweep = sources.withColumn("lr", F.explode(F.array(F.lit(1e-3), F.lit(1e-4)))).withColumn("batch", F.explode(F.array(F.lit(8), F.lit(16), F.lit(32))))
    return sweep.select("source", "lr", "batch", F.ceil(F.col("n") / F.col("batch")).cast("long").alias("steps"))
