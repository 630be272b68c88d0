"""The export gate, rule checks and routing of question-and-answer items.

Items have the columns rag_id, ord, brand, model, trim, category, module, intent, answer_type, answer, review_type,
knowledge_status, need_confirm, exportable, knowledge_type, questions and fact_refs (arrays). Null and empty are one thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dates import DATE_WORDS, policy_periods
from factloom.functions.prices import price_set
from factloom.functions.text import has_any, text

# Review types, states and need_confirm values that block export.
BLOCKING_REVIEW = ["missing", "conflict", "inference", "range_issue"]
BLOCKING_STATUS = ["missing", "unconfirmed", "invalid"]
CONFIRM = ["是", "yes", "true", "1"]

# Phrases that say an answer is missing; hints that do so beside one of the last list.
MISSING = ["资料未提供", "暂未提供", "目前没有", "目前还没有", "没有相关信息", "无法确认", "尚不清楚", "需要人工确认", "未找到", "未提供", "缺少"]
MISSING_HINTS = ["建议咨询门店", "建议您咨询门店", "建议咨询当地门店", "建议您咨询当地门店", "参考后续官方信息"]
MISSING_BESIDE = ["没有", "缺少", "未找到", "未提供", "无法确认"]

# Phrases of a price overview that needs more than one price; patterns whose source is unclear; topics that
# may not stay unconfirmed.
SINGLE_PRICE = ["不同版本价格会有差异", "不同版本价格会有差别", "不同配置价格会有差异", "不同配置价格会有差别"]
UNCLEAR = [r"高级皮质.{0,8}座椅", r"后排座椅.{0,12}前后滑动", "放置大件物品", r"L2级智能驾驶辅助功能.{0,60}全景影像系统", "日常行驶和停车会更省心", r"12\.3英寸高清触控屏", "全场景语音交互", "日常导航、听歌"]
HIGH_RISK = ["金融", "贷款", "分期", "首付", "利率", "费率", "质保", "保养", "售后"]

# Topics by keyword, the first that occurs wins.
TOPICS = {
    "价格": ["价格", "售价", "指导价", "建议零售价", "官方价", "多少钱", "价位", "起售价"],
    "金融政策": ["金融", "贷款", "分期", "免息", "0息", "贴息", "费率", "月供", "首付"],
    "续航": ["续航", "CLTC", "纯电续航", "综合续航", "电池"],
    "购车权益": ["购车权益", "权益", "限时权益", "下定权益", "优惠", "补贴", "置换", "增购", "定金", "抵扣", "选装减免", "现车礼"],
    "智驾": ["智驾", "辅助驾驶", "智能驾驶", "领航", "泊车"],
    "动力": ["动力", "电机", "发动机", "扭矩", "功率", "加速"],
    "补能": ["补能", "充电", "快充", "对外供电"],
    "空间": ["空间", "轴距", "车长", "尺寸"],
}
OTHER_TOPIC = "其他"
PRICE_TOPIC = "价格"
WHOLE_RANGE = "全系"
UNCONFIRMED_TRIM = "需确认"

# Texts that the gate writes.
DEFAULT_REASON = "待确认或缺失型知识不进入正式Excel"
COVERED_REASON = "同车型同主题已有有效知识，缺失型RAG不进入正式Excel"

# Words by which items go to a language model.
DYNAMIC_TYPES = ["dynamic", "price", "policy", "finance", "marketing"]
POLICY_WORDS = ["价格", "售价", "指导价", "多少钱", "金融", "贷款", "分期", "免息", "0息", "贴息", "利率", "费率", "首付", "月供", "置换", "增换购", "以旧换新", "补贴", "优惠", "权益", "现金", "活动", "限时", "下订", "下定", "锁单", "截止", "有效期"]
SCOPE_WORDS = ["全系", "部分车型", "指定版本", "全国", "部分地区", "门店", "地区", "仅限", "不含", "除外", "适用"]

# Words and patterns of the row and group checks.
VERSION_WORDS = ["Pro", "Max", "旗舰", "黑骑士", "青春版", "+"]
EXCLUDED = "除180系列外"
EXCLUDED_BESIDE = ["Pro", "Max", "Pro+", "Max+"]
ADAS_WORDS = ["自动驾驶", "自己开", "不用管", "解放双手", "自动变道无需接管"]
QUESTION_KINDS = {
    "experience": ["好不好用", "怎么样", "舒服", "体验"],
    "screen_size": ["屏幕多大", "几英寸", "尺寸"],
    "chip": ["芯片", "内存", "存储"],
    "price": ["多少钱", "价格", "售价"],
    "finance": ["金融", "贷款", "免息"],
}
STRONG_POLICY = ["限时", "活动期间", "截至", "截止", "有效期", "下定", "下订", "订车", "大定", "锁单", "补贴", "抵扣", "优惠价", "金融费率", "贴息", "首付", "月供", "政策周期", "活动时间", "定金膨胀", "购置税补贴", "置换补贴", "选装减免", "指定现车礼"]
POLICY_SOURCES = ["营销政策", "活动政策", "权益政策", "购车政策", "销售政策", "优惠政策", "金融政策", "促销", "限时权益"]
STATIC_SERVICE = ["质保", "保修", "三电", "整车质保", "道路救援", "救援", "车联网", "基础流量", "娱乐流量", "流量", "ADS", "智驾", "辅助驾驶", "功能包", "车辆配置", "配置", "座舱", "续航", "补能", "空间", "尺寸", "动力", "安全", "舒适", "售后", "基础保障"]
DATE = r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}"
CONFIG_WORDS = ["屏", "芯片", "内存", "存储", "气囊", "座椅", "调节", "快充", "尺寸", "参数"]
CORE_WORDS = ["空间", "动力", "续航", "补能", "智驾", "安全", "舒适", "车型"]
PRICE_WORDS = ["价格", "售价", "指导价", "多少钱", "价位", "起售价"]
LONG_ANSWER = 180

# Issue types.
NO_QUESTION, NO_ANSWER, NOT_EXPORTABLE, BAD_REFS = "问题为空", "回答为空", "不可导出知识", "Fact引用异常"
VERSION_MISMATCH, TOO_LONG, CONTRADICTION, MISPLACED = "版本范围不一致", "回答过长", "版本范围描述冲突", "静态动态分类可能错误"
ADAS_CLAIM, TOO_BROAD = "智驾表达可能越界", "问题粒度过大"
DUPLICATE, MIXED_PERIODS, CONFIG_HEAVY, NO_OVERVIEW = "重复知识", "政策周期混合风险", "配置FAQ比例过高", "缺少车型级价格概览知识"

MARKS = r"[，。！？、,.!?；;：:\-_/\\|（）()【】\[\]\"']"


def c(name: str) -> Column:
    return text(F.col(name))


def joined_questions(sep: str = " ") -> Column:
    """The non-empty questions as one text."""
    return F.array_join(F.filter(F.coalesce("questions", F.array().cast("array<string>")), lambda q: q != ""), sep)


def first_question() -> Column:
    return F.coalesce(F.get(F.filter("questions", lambda q: q != ""), F.lit(0)), F.lit(""))


def item_text() -> Column:
    """All fields by which an item is judged, joined by spaces, with its questions."""
    fields = ("brand", "model", "trim", "category", "module", "intent", "answer_type", "answer", "review_type", "knowledge_status")
    return F.concat_ws(" ", *(c(f) for f in fields), joined_questions())


def topic(whole: Column) -> Column:
    """The first topic with a word in the item's text, else its category or module."""
    found = F.when(c("category") != "", c("category")).when(c("module") != "", c("module")).otherwise(OTHER_TOPIC)
    for name, words in reversed(TOPICS.items()):
        found = F.when(has_any(whole, words), name).otherwise(found)
    return found


def model_key() -> Column:
    return F.regexp_replace(F.regexp_replace(c("model"), r"(?U)\s+", ""), "^新(?=阿维塔)", "")


def missing_answer() -> Column:
    a = c("answer")
    return (F.trim(a) == "") | has_any(a, MISSING) | (has_any(a, MISSING_HINTS) & has_any(a, MISSING_BESIDE))


def judged(items: DataFrame) -> DataFrame:
    """Adds whole (the item's text), topic, exportable_now (no veto holds) and effective (it can serve as an answer).

    The texts are computed once, in a projection of their own."""
    items = items.withColumn("whole", item_text()).withColumn("topic", topic(F.col("whole")))
    whole, trim = F.col("whole"), F.trim(c("trim"))
    vetoes = [
        F.coalesce(~F.col("exportable"), F.lit(False)),
        F.lower(c("answer_type")) == "need_confirm",
        F.trim(c("need_confirm")).isin(CONFIRM),
        c("review_type").isin(BLOCKING_REVIEW),
        (trim == UNCONFIRMED_TRIM) & has_any(whole, HIGH_RISK),
        (F.col("topic") == PRICE_TOPIC) & (trim == WHOLE_RANGE) & has_any(whole, SINGLE_PRICE) & (F.size(price_set(whole)) == 1),
        whole.rlike("|".join(UNCLEAR)),
        F.lower(c("knowledge_status")).isin(BLOCKING_STATUS),
        missing_answer(),
    ]
    blocked = vetoes[0]
    for v in vetoes[1:]:
        blocked = blocked | v
    items = items.withColumn("exportable_now", ~blocked)
    answers = c("answer_type").isin("fact_answer", "sales_translation") | (F.size(F.coalesce("fact_refs", F.array().cast("array<string>"))) > 0)
    return items.withColumn("effective", F.col("exportable_now") & answers)


KEY = ("brand", "model_key", "topic")


def gated(items: DataFrame) -> DataFrame:
    """The items with exportable, export_block_reason, review_type, knowledge_status as the gate leaves them.

    Keys that have an effective answer are a small, distinct table beside the items, so that no key is gathered."""
    rows = judged(items).withColumn("model_key", model_key())
    if "export_block_reason" not in items.columns:
        rows = rows.withColumn("export_block_reason", F.lit(None).cast("string"))
    covered = rows.where("effective").select(c("brand").alias("brand"), "model_key", "topic").distinct().withColumn("covered", F.lit(True))
    rows = rows.withColumn("brand", c("brand")).join(covered, list(KEY), "left")
    ok = F.col("exportable_now")
    review = F.when(c("review_type").isin(BLOCKING_REVIEW), c("review_type")).otherwise("missing")
    return rows.withColumns(
        {
            "exportable": ok,
            "export_block_reason": F.when(~ok, F.when(F.col("covered"), COVERED_REASON).otherwise(F.coalesce("export_block_reason", F.lit(DEFAULT_REASON)))),
            "review_type": F.when(ok, c("review_type")).otherwise(review),
            "knowledge_status": F.when(ok, c("knowledge_status")).when(review == "missing", "missing").otherwise("unconfirmed"),
        }
    ).drop("covered", "whole")


def price_conflicts(items: DataFrame) -> DataFrame:
    """Groups (brand, model, trim) whose effective one-price answers state several prices: the first item's model, trim
    and the text that reports them."""
    rows = judged(items).where(F.col("effective") & (F.col("topic") == PRICE_TOPIC)).withColumn("prices", price_set(c("answer"))).where("size(prices) = 1")
    trim = F.when(c("trim") == "", WHOLE_RANGE).otherwise(c("trim"))
    groups = rows.groupBy(c("brand").alias("brand"), model_key().alias("model_key"), trim.alias("trim")).agg(F.min_by("model", "ord").alias("model"), F.array_sort(F.collect_set(F.col("prices")[0])).alias("prices"))
    spelt = F.transform("prices", lambda v: F.concat(F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", ""), F.lit("万元")))
    return groups.where("size(prices) > 1").select("brand", "model", "trim", F.concat(F.coalesce("model", F.lit("")), "trim", F.lit("存在多个价格："), F.array_join(spelt, "、")).alias("item"))


def block_reason() -> Column:
    """The first rule by which an item is not exportable, as the checks name it; empty if none is."""
    low = lambda f: F.lower(F.trim(c(f)))
    return (
        F.when(F.coalesce(~F.col("exportable"), F.lit(False)), "exportable=false")
        .when(low("answer_type") == "need_confirm", "answer_type=need_confirm")
        .when(low("need_confirm").isin(CONFIRM), "need_confirm")
        .when(F.trim(c("review_type")).isin(BLOCKING_REVIEW), F.concat(F.lit("review_type="), F.trim(c("review_type"))))
        .when(low("knowledge_status").isin(BLOCKING_STATUS), F.concat(F.lit("knowledge_status="), low("knowledge_status")))
        .when(missing_answer(), "missing_answer")
        .otherwise("")
    )


def _issues(rows: DataFrame, rules: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """Rows to the issues whose rule holds: rag_id, issue_type, risk_level, detail."""
    found = F.array(*(F.when(holds, F.struct(F.lit(kind).alias("issue_type"), F.lit(level).alias("risk_level"), detail.alias("detail"))) for holds, kind, level, detail in rules))
    return rows.select("rag_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("rag_id", "i.*")


def rule_issues(items: DataFrame) -> DataFrame:
    """Issues that rules alone find: empty question or answer, items that may not be exported, malformed references."""
    rows = judged(items).withColumn("why", block_reason())
    none = F.lit("")
    malformed = F.col("fact_refs").isNull() | F.exists("fact_refs", lambda r: F.trim(F.coalesce(r, F.lit(""))) == "")
    return _issues(
        rows,
        [
            (F.trim(joined_questions()) == "", NO_QUESTION, "error", none),
            (F.trim(c("answer")) == "", NO_ANSWER, "error", none),
            (F.col("why") != "", NOT_EXPORTABLE, "error", F.col("why")),
            (F.col("exportable_now") & malformed, BAD_REFS, "warning", none),
        ],
    )


def routes(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Each item's route: rule_issue, llm or rule_pass, with the reasons, sorted and comma-joined."""
    hit = issues.select(F.col("rag_id").alias("hit")).distinct()
    rows = judged(items).join(hit, F.col("rag_id") == F.col("hit"), "left")
    fields = ("brand", "model", "trim", "category", "knowledge_type", "module", "intent", "answer")
    whole = F.concat_ws(" ", *(c(f) for f in fields), joined_questions())
    refs = F.size(F.filter(F.coalesce("fact_refs", F.array().cast("array<string>")), lambda r: F.trim(r) != ""))
    signals = [
        F.when(F.lower(c("knowledge_type")).isin(DYNAMIC_TYPES), F.lit("DYNAMIC_KNOWLEDGE")),
        F.when(refs > 1, F.lit("MULTI_FACT")),
        F.when(F.size(F.regexp_extract_all(c("answer"), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))) >= 3, F.lit("MULTI_NUMERIC_CONDITION")),
        F.when(has_any(whole, POLICY_WORDS), F.lit("POLICY_OR_PRICE_SIGNAL")),
        F.when(has_any(whole, SCOPE_WORDS), F.lit("SCOPE_COMPLEXITY")),
    ]
    rows = rows.withColumn("signals", F.array_join(F.filter(F.array(*signals), lambda x: x.isNotNull()), ","))
    stop = F.col("hit").isNotNull()
    route = F.when(stop | ~F.col("exportable_now"), "rule_issue").when(F.col("signals") != "", "llm").otherwise("rule_pass")
    reasons = F.when(stop, "RULE_ISSUE").when(~F.col("exportable_now"), "NON_EXPORTABLE").when(F.col("signals") != "", F.col("signals")).otherwise("LOW_RISK_STATIC_SINGLE_FACT")
    return rows.select("rag_id", route.alias("route"), reasons.alias("reasons"))


def _checked_text() -> Column:
    return F.concat_ws(" ", c("category"), c("module"), joined_questions(), c("answer"))


def _dated(whole: Column) -> Column:
    return whole.rlike(DATE) & has_any(whole, DATE_WORDS)


def misplaced(whole: Column) -> Column:
    """Whether a static item speaks of a dynamic policy, not only of a standing service."""
    strong = has_any(whole, STRONG_POLICY) | _dated(whole)
    return (c("knowledge_type") == "static") & (strong | (has_any(whole, POLICY_SOURCES) & ~has_any(whole, STATIC_SERVICE)))


def _live(items: DataFrame) -> DataFrame:
    rows = judged(items).where("exportable_now").drop("whole")
    return rows.withColumn("checked", _checked_text()).withColumn("asked", joined_questions())


def row_issues(items: DataFrame) -> DataFrame:
    """Warnings on single exportable items."""
    a, trim, none = c("answer"), c("trim"), F.lit("")
    named = F.filter(F.array(*(F.when(a.contains(w), F.lit(w)) for w in VERSION_WORDS)), lambda x: x.isNotNull())
    kinds = sum((has_any(F.col("asked"), words).cast("int") for words in QUESTION_KINDS.values()), F.lit(0))
    return _issues(
        _live(items),
        [
            ((trim != "") & ~trim.isin(WHOLE_RANGE, "不同版本") & (F.size(named) >= 2) & F.exists(named, lambda w: ~F.contains(trim, w)), VERSION_MISMATCH, "warning", none),
            ((c("knowledge_type") == "dynamic") & (F.length(a) > LONG_ANSWER), TOO_LONG, "warning", none),
            (a.contains(EXCLUDED) & has_any(a, EXCLUDED_BESIDE), CONTRADICTION, "warning", none),
            (misplaced(F.col("checked")), MISPLACED, "warning", none),
            (has_any(a, ADAS_WORDS), ADAS_CLAIM, "warning", none),
            (kinds >= 2, TOO_BROAD, "warning", none),
        ],
    )


def scoped_trim() -> Column:
    """The trim of an item whose answer names several versions that the trim does not: it becomes 不同版本."""
    trim, whole = c("trim"), c("answer")
    named = F.filter(F.array(*(F.when(whole.contains(w), F.lit(w)) for w in VERSION_WORDS)), lambda x: x.isNotNull())
    wider = (F.size(named) >= 2) & F.exists(named, lambda w: ~F.contains(trim, w))
    return F.when(~trim.isin("", UNCONFIRMED_TRIM, WHOLE_RANGE) & wider, "不同版本").otherwise(trim)


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", ""), MARKS, "")


def group_issues(items: DataFrame) -> DataFrame:
    """Warnings on groups of exportable items; rag_id is that of the first duplicate, else empty."""
    rows = _live(items)
    keyed = rows.withColumn("kind", F.coalesce("category", "module", F.lit("")))
    same = keyed.groupBy(c("model").alias("model"), "kind", _squeezed(F.col("asked")).alias("q"), F.left(_squeezed(c("answer")), F.lit(80)).alias("a"))
    twice = same.agg(F.min_by("rag_id", "ord").alias("rag_id"), F.count_distinct(c("trim")).alias("trims")).where("trims > 1").select("rag_id", F.lit(DUPLICATE).alias("issue_type"), F.lit("").alias("detail"))
    months = keyed.where("knowledge_type = 'dynamic'").select(c("model").alias("model"), "kind", F.explode(policy_periods(F.col("checked"))).alias("month"))
    mixed = months.groupBy("model", "kind").agg(F.array_join(F.array_sort(F.collect_set("month")), "、").alias("months"), F.count_distinct("month").alias("n")).where("n > 1")
    mixed = mixed.select(F.lit("").alias("rag_id"), F.lit(MIXED_PERIODS).alias("issue_type"), F.concat(F.lit("发现"), "model", F.lit("存在多个"), "kind", F.lit("周期："), "months").alias("detail"))
    whole, trim = F.col("checked"), c("trim")
    core = trim.isin(WHOLE_RANGE, "不同版本")
    priced = has_any(whole, PRICE_WORDS)
    by_model = rows.where(c("model") != "").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_any(whole, CONFIG_WORDS)).alias("config"),
        F.count_if(core & has_any(whole, CORE_WORDS)).alias("core"),
        F.count_if(priced & ~(core | (trim == ""))).alias("version_prices"),
        F.count_if(priced & (core | (trim == ""))).alias("model_prices"),
    )
    of_model = lambda holds, kind: by_model.where(holds).select(F.lit("").alias("rag_id"), F.lit(kind).alias("issue_type"), F.col("model").alias("detail"))
    heavy = of_model("n >= 10 AND config / n > 0.45 AND core < 4", CONFIG_HEAVY)
    without = of_model("version_prices >= 2 AND model_prices = 0", NO_OVERVIEW)
    return twice.unionAll(mixed).unionAll(heavy).unionAll(without).withColumn("risk_level", F.lit("warning"))


def qc_summary(items: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: items, warnings, errors, what is left of the items, and the verdict."""
    counts = issues.agg(F.count_if(F.col("risk_level") == "warning").alias("warning"), F.count_if(F.col("risk_level") == "error").alias("error"))
    out = items.agg(F.count(F.lit(1)).alias("total_rag")).crossJoin(counts)
    out = out.withColumn("pass", F.greatest(F.col("total_rag") - F.col("warning") - F.col("error"), F.lit(0)))
    return out.withColumn("overall_result", F.when(F.col("error") > 0, "需处理").when(F.col("warning") > 0, "需优化").otherwise("通过"))


def distinct_issues(issues: DataFrame, key: tuple[str, ...] = ("rag_id", "issue_type", "description"), order: str = "ord") -> DataFrame:
    """The first issue of each key by order."""
    columns = [x for x in issues.columns if x not in key]
    return issues.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("first")).select(*key, "first.*")
