"""What a prediction says to its reader, as expressions over top-k classes, abstention and band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.scalars import NORMAL

# Names of the classes, how urgent each is, words of the bands, and the sentences.
NAMES = {"A1": "구진·플라크", "A2": "비듬·각질·상피성잔고리", "A3": "태선화·과다색소침착", "A4": "농포·여드름", "A5": "미란·궤양", "A6": "결절·종괴", "A7": "무증상(정상)"}
ENGLISH = {"A1": "Papule / Plaque", "A2": "Scale / Crust / Epidermal collarette", "A3": "Lichenification / Hyperpigmentation", "A4": "Pustule / Acne", "A5": "Erosion / Ulcer", "A6": "Nodule / Mass", "A7": "Normal / Asymptomatic"}
URGENCY = {"A3": "만성 경과 가능 — 진료 권장", "A4": "감염 동반 가능 — 진료 권장", "A5": "피부 장벽 손상 — 조기 진료 권장", "A6": "종양 감별 필요 — 조기 진료 권장"}
BANDS = {"high": "높음", "middle": "보통", "low": "낮음"}
DISCLAIMER = "이 결과는 수의학적 진단이 아니며, 수의사의 진료를 대체하지 않습니다. 참고용 스크리닝 정보로만 사용해 주세요."
AGAIN = "📷 **판단이 어려운 사진입니다.**\n\n병변 부위가 화면 가운데에 오도록, 밝은 곳에서 초점을 맞춰 다시 찍어주세요.\n털에 가려져 있다면 손으로 살짝 헤쳐 피부가 보이게 해주시면 좋습니다."
CLEAR = "🟢 **뚜렷한 피부 병변 소견은 보이지 않습니다.**\n\n다만 사진 한 장으로 확인할 수 있는 범위에는 한계가 있습니다.\n가려워하거나, 냄새가 나거나, 계속 핥는 등 평소와 다른 행동이 있다면 결과와 무관하게 병원에 가보시는 것을 권합니다."
SUSPECT = "🔎 **{name}** 형태의 병변이 의심됩니다. (신뢰도 {p}, {band})"
NO_NAME = "이건 **병변의 겉모습**에 대한 소견이지 병명이 아닙니다. 같은 모양이라도 원인 질환은 알레르기, 감염, 내분비 질환 등 여러 가지일 수 있고, 원인에 따라 치료가 완전히 달라집니다."
OTHERS = "다른 가능성: "
UNSURE = "_신뢰도가 낮습니다. 사진을 더 선명하게 다시 찍으면 결과가 달라질 수 있습니다._"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a small table, else the key."""
    out = key
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def percent(p: Column) -> Column:
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def message(topk: Column | str, abstain: Column | str, band: Column | str, show: int = 3) -> Column:
    """Markdown for the reader. topk: array of (class, p), class a code; band: high, middle or low."""
    topk, abstain, word = _c(topk), _c(abstain), lookup(BANDS, _c(band))
    first = F.get(topk, F.lit(0))
    before, after = (SUSPECT.split(x, 1) for x in ("{name}", "{p}"))
    head = F.concat(F.lit(before[0]), lookup(NAMES, first["class"]), F.lit(before[1].split("{p}")[0]), percent(first["p"]), F.lit(after[1].split("{band}")[0]), word, F.lit(after[1].split("{band}")[1]))
    urgency = F.nullif(lookup({**{k: "" for k in NAMES}, **URGENCY}, first["class"]), F.lit(""))
    urgency = F.when(first["class"].isin(*URGENCY), F.concat(F.lit("⚠️ "), urgency))
    body = F.when(first["class"] == NORMAL, F.lit(CLEAR)).otherwise(F.concat_ws("\n\n", head, urgency, F.lit(NO_NAME)))
    rest = F.array_join(F.transform(F.slice(topk, 2, show - 1), lambda t: F.concat(lookup(NAMES, t["class"]), F.lit(" "), percent(t["p"]))), ", ")
    others = F.when(rest != "", F.concat(F.lit(OTHERS), rest))
    low = F.when(word == BANDS["low"], F.lit(UNSURE))
    end = F.lit(f"_{DISCLAIMER}_")
    return F.when(F.coalesce(abstain, F.lit(False)) | (F.coalesce(F.size(topk), F.lit(0)) < 1), F.concat_ws("\n\n", F.lit(AGAIN), end)).otherwise(F.concat_ws("\n\n", body, others, low, end))


def prediction_json(image: Column | str, topk: Column | str, abstain: Column | str, band: Column | str) -> Column:
    """The prediction as JSON text, with the names of its classes."""
    named = F.transform(_c(topk), lambda t: F.struct(t["class"].alias("class"), lookup(NAMES, t["class"]).alias("name_ko"), lookup(ENGLISH, t["class"]).alias("name_en"), F.round(t["p"], 4).alias("prob")))
    return F.to_json(F.struct(_c(image).alias("image"), _c(abstain).alias("abstain"), lookup(BANDS, _c(band)).alias("confidence_band"), named.alias("topk"), F.lit(DISCLAIMER).alias("disclaimer")))
