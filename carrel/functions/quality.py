"""Quality, completeness, metric and reward expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.functions.text import tokens

# Words of medical reports.
MEDICAL_WORDS = """
lung lungs lobe lobes bronchus bronchi trachea mediastinum pleura pleural diaphragm hilum hilar pericardium pericardial cardiac heart aorta aortic pulmonary thorax thoracic sternum rib ribs
liver hepatic spleen splenic kidney kidneys renal pancreas pancreatic gallbladder adrenal bowel colon intestine stomach gastric duodenum appendix mesentery peritoneum peritoneal retroperitoneal bladder uterus ovary prostate
brain cerebral cerebellum cerebellar ventricle ventricular cortex cortical hippocampus thalamus brainstem pons midbrain skull calvarium meninges meningeal dura dural spinal spine vertebra vertebral disc foramen
femur tibia fibula humerus radius ulna pelvis acetabulum scapula clavicle patella meniscus tendon ligament cartilage joint muscle bone marrow
artery arterial vein venous vessel vascular carotid jugular subclavian iliac femoral portal
nodule nodular mass lesion tumor tumour cyst calcification opacity opacification consolidation atelectasis effusion edema oedema hemorrhage haemorrhage infarct infarction thrombosis thrombus embolism stenosis occlusion aneurysm dissection
fracture dislocation erosion sclerosis fibrosis necrosis abscess inflammation metastasis metastatic lymphadenopathy cardiomegaly hepatomegaly splenomegaly pneumothorax pneumonia emphysema hernia herniation hydrocephalus demyelination enhancement enhancing
ct mri mra pet spect ultrasound radiograph x-ray xray fluoroscopy mammography angiography echocardiography doppler scan imaging contrast gadolinium iodine
patient diagnosis impression findings indication history clinical chronic acute bilateral unilateral anterior posterior lateral medial superior inferior proximal distal diffuse focal mild moderate severe benign malignant normal abnormal stable unchanged interval follow-up followup prior comparison technique protocol axial coronal sagittal
mm cm diameter size volume density signal intensity attenuation hyperintense hypointense hyperdense hypodense heterogeneous homogeneous circumscribed irregular spiculated ground-glass
""".split()  # fmt: skip
WEIGHTS = {"vocabulary": 0.35, "characters": 0.25, "structure": 0.20, "length": 0.20}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def vocabulary_score(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[a-zA-Z][\w'-]*"), F.lit(0))
    # the words are extracted once and bound to a lambda's variable
    share = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: x.isin(*MEDICAL_WORDS))) / F.size(w)).otherwise(0.0))
    return F.least(F.lit(1.0), F.get(share, F.lit(0)) / 0.30)


# Tokens are counted on the text itself, so that no array of words is built. Other white space becomes blanks first: patterns
# without the Unicode flag are several times as fast.
_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = r"\S++"
_LETTERED = r"[A-Za-z]\S*+"
_MIXED = r"(?<!\S)[^\sA-Za-z\d]*+(?:[A-Za-z][^\s\d]*+\d|\d[^\sA-Za-z]*+[A-Za-z])\S*+"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once: conditional branches would evaluate it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measures(text: Column) -> Column:
    """struct of the counts that the scores need, each found in one pass over the text."""
    t = F.translate(text, _BLANKS, " " * len(_BLANKS))
    return _bound(t, lambda x: F.struct(
        F.char_length(x).alias("chars"), F.regexp_count(x, F.lit(_TOKEN)).alias("words"), F.char_length(F.regexp_replace(x, r"\s+", "")).alias("solid"),
        F.char_length(F.regexp_replace(text, r"[^ \t\n]+", "")).alias("blank"), F.regexp_count(x, F.lit(_LETTERED)).alias("lettered"), F.regexp_count(x, F.lit(_MIXED)).alias("mixed"),
        F.char_length(F.regexp_replace(text, r"[A-Za-z0-9\s.,;:!?'\-/()+=%°\x0b]+", "")).alias("odd")))


def _characters(m: Column) -> Column:
    base = (m["chars"] - m["odd"]) / m["chars"]
    return F.when(m["chars"] == 0, 0.0).when(m["words"] == 0, base).otherwise(base * F.greatest(F.lit(0.0), 1 - m["mixed"] / m["words"]))


def _structure(m: Column) -> Column:
    mean, blank = m["solid"] / m["words"], m["blank"] / m["chars"]
    by_length = F.when(mean.between(3, 10), 1.0).when((mean < 2) | (mean > 15), 0.2).otherwise(0.6)
    by_blank = F.when(blank.between(0.10, 0.35), 1.0).when((blank < 0.05) | (blank > 0.50), 0.2).otherwise(0.6)
    return F.when(m["words"] == 0, 0.0).otherwise((by_length + by_blank) / 2 * m["lettered"] / m["words"])


def _length(m: Column, pages: Column | int) -> Column:
    p = pages if isinstance(pages, Column) else F.lit(pages)
    ratio = m["words"] / (p * 400)
    return F.when(m["words"] == 0, 0.0).when(p * 400 == 0, 0.5).when(ratio.between(0.3, 2.5), 1.0).when(ratio < 0.1, 0.1).otherwise(0.5)


def character_score(text: Column) -> Column:
    return _bound(_measures(text), _characters)


def structure_score(text: Column) -> Column:
    return _bound(_measures(text), _structure)


def length_score(text: Column, pages: Column | int = 1) -> Column:
    return _bound(_measures(text), lambda m: _length(m, pages))


def quality(text: Column, pages: Column | int = 1) -> Column:
    """struct<vocabulary, characters, structure, length, overall>; a blank text scores 0 throughout."""

    def scores(m: Column) -> Column:
        parts = F.struct(m["v"].alias("vocabulary"), _characters(m["m"]).alias("characters"), _structure(m["m"]).alias("structure"), _length(m["m"], pages).alias("length"))
        return F.when(m["m"]["words"] > 0, parts).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in WEIGHTS]))

    def rounded(s: Column) -> Column:
        total = sum((F.lit(w) * s[k] for k, w in WEIGHTS.items()), F.lit(0.0))
        return F.struct(*[F.round(s[k], 6).alias(k) for k in WEIGHTS], F.round(total, 6).alias("overall"))

    return _bound(_bound(F.struct(vocabulary_score(text).alias("v"), _measures(text).alias("m")), scores), rounded)


# ---- completeness ---------------------------------------------------------------------------------------------------
def populated(value: Column, kind: str = "string") -> Column:
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def field_coverage(flags: list[Column]) -> Column:
    return sum((F.when(f, 1.0).otherwise(0.0) for f in flags), F.lit(0.0)) / len(flags) if flags else F.lit(0.0)


def information_density(source: Column, structured_json: Column) -> Column:
    n = F.size(_words(source))
    return F.when(n > 0, F.least(F.size(_words(structured_json)) / n, F.lit(1.0))).otherwise(0.0)


def completeness(flags: list[Column], source: Column, structured_json: Column) -> Column:
    """0.7 x coverage + 0.3 x density."""
    return 0.7 * field_coverage(flags) + 0.3 * F.coalesce(information_density(source, structured_json), F.lit(0.0))


def report_completeness(required: dict[str, Column], optional: dict[str, Column]) -> Column:
    """struct<overall, required_coverage, optional_coverage, missing_required>; required fields weigh 1.0, optional 0.3, an empty side counts as full."""
    full = lambda d: field_coverage(list(d.values())) if d else F.lit(1.0)
    weight = len(required) + 0.3 * len(optional)
    got = sum((F.when(f, 1.0).otherwise(0.0) for f in required.values()), F.lit(0.0)) + 0.3 * sum((F.when(f, 1.0).otherwise(0.0) for f in optional.values()), F.lit(0.0))
    missing = F.filter(F.array(*[F.when(~f, F.lit(k)) for k, f in required.items()]).cast("array<string>"), lambda x: x.isNotNull())
    return F.struct((got / weight if weight else F.lit(1.0)).alias("overall"), full(required).alias("required_coverage"), full(optional).alias("optional_coverage"), missing.alias("missing_required"))


# ---- metrics --------------------------------------------------------------------------------------------------------
NUMBER = r"[-+]?\d*\.?\d+"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def numeric_exactness(expected: Column, response: Column) -> Column:
    """1 within 1 %, then down by five times the relative error; 1 where nothing numeric is expected."""
    e, r = first_number(expected), first_number(response)
    err = F.abs(r - e)
    return F.when(e.isNull(), 1.0).when(r.isNull(), 0.0).when(err <= F.greatest(F.lit(1e-9), F.abs(e) * 0.01), 1.0).otherwise(clamp(1 - 5 * err / F.greatest(F.abs(e), F.lit(1.0))))


def support(words: Column, context: Column) -> Column:
    a, b = F.array_distinct(tokens(words)), tokens(context)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def groundedness(question: Column, response: Column, context: Column) -> Column:
    """0.45 x question words + 0.55 x response words that the context holds."""
    value = 0.45 * F.coalesce(support(question, context), F.lit(1.0)) + 0.55 * F.coalesce(support(response, context), F.lit(1.0))
    return F.when(F.size(tokens(context)) > 0, clamp(value)).otherwise(0.0)


def exact_match(expected: Column, response: Column) -> Column:
    flat = lambda t: F.array_join(tokens(t), " ")
    return F.when(flat(expected) == flat(response), 1.0).otherwise(0.0)


def passage_match(response: Column, context: Column) -> Column:
    return F.coalesce(F.when(F.size(tokens(context)) > 0, support(response, context)), F.lit(0.0))


def query_score(grounding: Column, numeric: Column, has_number: Column) -> Column:
    return F.when(has_number, 0.4 * grounding + 0.6 * numeric).otherwise(grounding)


def verify_score(gold: Column, predicted: Column, confidence: Column) -> Column:
    hit = F.when((F.trim(gold) != "") & (F.lower(F.trim(gold)) == F.lower(F.trim(predicted))), 1.0).otherwise(0.0)
    return 0.8 * hit + 0.2 * clamp(F.coalesce(confidence, F.lit(0.5)))


def count_likeness(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def same_text(gold: Column, predicted: Column) -> Column:
    return F.when((F.trim(F.coalesce(gold, F.lit(""))) != "") & (F.lower(F.trim(gold)) == F.lower(F.trim(predicted))), 1.0).otherwise(0.0)


def pathology_metric(findings: Column, gold_findings: Column, specimen: Column, gold_specimen: Column, description: str = "description") -> Column:
    """0.4 described findings + 0.3 count likeness + 0.3 equal specimen."""
    described = F.when(F.size(findings) > 0, F.size(F.filter(findings, lambda f: F.coalesce(f[description] != "", F.lit(False)))) / F.size(findings)).otherwise(0.0)
    return 0.4 * described + 0.3 * count_likeness(F.size(gold_findings), F.size(findings)) + 0.3 * same_text(gold_specimen, specimen)


def radiology_metric(reward: Column, findings: Column, gold_findings: Column, exam: Column, gold_exam: Column) -> Column:
    """0.6 reward + 0.2 equal exam + 0.2 count likeness."""
    return 0.6 * reward + 0.2 * same_text(gold_exam, exam) + 0.2 * count_likeness(F.size(gold_findings), F.size(findings))


def summary_metric(gold: Column, predicted: Column) -> Column:
    """0.4 length (50 characters or more) + 0.6 gold words held."""
    return 0.4 * F.least(F.lit(1.0), F.char_length(F.coalesce(predicted, F.lit(""))) / 50) + 0.6 * F.coalesce(support(gold, predicted), F.lit(0.0))


def deidentify_metric(leak: Column, original: Column, redacted: Column) -> Column:
    """0.6 no leak + 0.4 words kept."""
    return 0.6 * leak + 0.4 * F.coalesce(support(redacted, original), F.lit(0.0))


def finding_reward(findings: Column, anatomy: str = "anatomy", observation: str = "observation") -> Column:
    """Share of findings that name a place and an observation; 0 without findings."""
    ok = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    score = F.aggregate(findings, F.lit(0.0), lambda a, f: a + F.when(ok(f[anatomy]), 0.5).otherwise(0.0) + F.when(ok(f[observation]), 0.5).otherwise(0.0))
    return F.when(F.size(findings) > 0, score / F.size(findings)).otherwise(0.0)


def impression_reward(impression: Column) -> Column:
    n = F.char_length(F.trim(F.coalesce(impression, F.lit(""))))
    return F.when(n == 0, 0.0).when(n < 10, 0.5).otherwise(1.0)


def extraction_pairs(gold: DataFrame, predicted: DataFrame, id_col: str) -> DataFrame:
    """(id, score): 0.5 x shared keys + 0.5 x equal values of shared keys, from flattened rows (id, path, value)."""
    g = gold.select(id_col, "path", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("g")).dropDuplicates([id_col, "path"])
    p = predicted.select(id_col, "path", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("p")).dropDuplicates([id_col, "path"])
    j = g.join(p, [id_col, "path"], "left").groupBy(id_col).agg(F.count("*").alias("keys"), F.count("p").alias("shared"), F.count(F.when(F.col("g") == F.col("p"), 1)).alias("same"))
    return j.select(id_col, F.round(0.5 * F.col("shared") / F.col("keys") + 0.5 * F.when(F.col("shared") > 0, F.col("same") / F.col("shared")).otherwise(0.0), 6).alias("score"))


# Thresholds of the gates.
QUERY_GATES = {"mean_score": 0.75, "grounding_mean": 0.70, "numeric_mean": 0.90, "numeric_pass_rate": 0.85, "exact_match_mean": 0.60, "passage_match_mean": 0.60}
VERIFY_GATES = {"mean_score": 0.90, "verdict_accuracy": 0.90, "confidence_mean": 0.70}


def query_gates(rows: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(name, value, threshold, passed) of rows (score, grounding, numeric, has_number, exact_match, passage_match); no rows pass nothing."""
    limits = QUERY_GATES | (thresholds or {})
    number = F.when(F.col("has_number"), F.col("numeric"))
    agg = rows.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.coalesce(F.avg("grounding"), F.lit(0.0)).alias("grounding_mean"), F.avg(number).alias("numeric_mean"),
        F.avg(F.when(F.col("has_number"), F.when(F.col("numeric") >= 0.95, 1.0).otherwise(0.0))).alias("numeric_pass_rate"), F.avg("exact_match").alias("exact_match_mean"), F.avg("passage_match").alias("passage_match_mean"),
    )
    return _gates(agg, limits)


def verify_gates(rows: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(name, value, threshold, passed) of rows (score, verdict_match, confidence)."""
    agg = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("score", "mean_score"), ("verdict_match", "verdict_accuracy"), ("confidence", "confidence_mean"))])
    return _gates(agg, VERIFY_GATES | (thresholds or {}))


def _gates(agg: DataFrame, limits: dict[str, float]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value"), F.lit(t).alias("threshold"), (F.col(n) >= t).alias("passed")) for n, t in limits.items()])
    return agg.select(F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))


def summary_stats(rows: DataFrame, column: str) -> DataFrame:
    """(n, mean, median, std, min, max) of scores."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


# What a measure looks like in a finding.
MEASUREMENT = r"(?i)\d+\s*(mm|cm|m|cc|ml|mg|g|kg|in|ft)"


def extraction_reward(findings: Column, impression: Column, anatomy: str = "anatomy", observation: str = "observation") -> Column:
    """.3 for findings, .1 for each with a place (.4 at most), .2 for an impression of more than 10 characters, .1 for each with a measure; 1 at most."""
    n = lambda test: F.size(F.filter(findings, test))
    placed = F.least(F.lit(0.4), 0.1 * n(lambda f: F.coalesce(F.trim(f[anatomy]) != "", F.lit(False))))
    score = F.when(F.size(findings) > 0, 0.3).otherwise(0.0) + placed + F.when(F.char_length(F.trim(F.coalesce(impression, F.lit("")))) > 10, 0.2).otherwise(0.0) + 0.1 * n(lambda f: F.coalesce(f[observation].rlike(MEASUREMENT), F.lit(False)))
    return F.least(F.lit(1.0), score)


def diagnosis_reward(diagnosis: Column) -> Column:
    """As impression_reward, for the diagnosis of a specimen."""
    return impression_reward(diagnosis)


def schema_metric(gold_fields: Column, fields: Column, compiles: Column) -> Column:
    """.7 share of the wanted field names (arrays of names) that are there + .3 if the schema compiles."""
    names = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x))))
    share = F.when(F.size(names(gold_fields)) > 0, F.size(F.array_intersect(names(gold_fields), names(fields))) / F.size(names(gold_fields))).otherwise(0.0)
    return 0.7 * share + 0.3 * F.when(compiles, 1.0).otherwise(0.0)


#: Metrics by pipeline; further ones may be put in.
METRICS = {"radiology": radiology_metric, "pathology": pathology_metric, "extract": extraction_pairs, "summarize": summary_metric, "deidentify": deidentify_metric, "query": query_score, "verify": verify_score, "schema": schema_metric}


def get_metric(pipeline: str):
    """The metric of a pipeline; an unknown one is a KeyError that lists the known ones."""
    if pipeline not in METRICS:
        raise KeyError(f"no metric for {pipeline!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[pipeline]


def list_metrics() -> list[str]:
    return sorted(METRICS)
