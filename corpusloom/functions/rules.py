"""Intents, entities and other rules of questions: data first, then the columns that apply it.

Site-specific vocabulary (names, hosts) is a parameter. Patterns are written for folded text (lower case, no
Turkish letters), so that word boundaries mean the same in every engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, once

# Patterns of question intents, in folded form.
INTENTS = {
    "department": r"depart|fakulte|fakult\b|bolum|facult(y|ies)|schools?\b|program\s*list|bolumler|yuksekokul|anabilim|meslek\s*yuksek|muhendis|tip\s*fak",
    "stem": r"\bcomputer\b|software|electrical|mechanical|civil|chemical|industrial|biomedical|\bengineering\b|\bengineer\b|programming|informatics|bilgisayar|yazilim|elektrik|elektronik|makine|insaat|yapay\s*zeka|veri\s*bilim",
    "location": r"\b(where\s+is|location|address|postal|contact|how\s+to\s+get|how\s+can\s+i\s+reach|reach\b|directions?|transport|transportation|campus\s+location|communication\s+and\s+transportation|nerede|konum|adres|iletisim|ulasim|kampus\s+konum)\b",
    "catalogue": r"\b(obs|oibs|bologna|course|courses|curriculum|syllabus|lesson|lessons|module|modules|ects|catalog|programme?\s+structure|program\s+outcomes?|learning\s+outcomes?|ders|dersler|mufredat|akts|katalog|kazanim)\b",
    "roster": r"\bteachers?\b|teaching\s+staff|\b(prof|faculty|professors?|instructors?|lecturers?)\b|ogretim|akademik\s+kadro|egitim\s+kadrosu|\bhocalar|ders\s+veren|educators?\b|academic\s+staff\b|kadro(ya)?\b",
    "leadership": r"\b(dean|deans|dekan|rector|rektor|rectorate|dekanlik|provost)\b",
    "fee": r"\b(price|prices|fee|fees|tuition|ucret|ucreti|ucretler|scholarship|burs|how\s+much|what\s+.*\s+cost|costs?|annual|yillik|ogrenim|payment|odeme)\b",
    "broad_fee": r"\b(tum|butun|hepsi|all|every|list\s+of\s+fees?|fee\s+list|ucret\s+listesi|ucretler\s+ne|what\s+are\s+the\s+fees)\b",
    "graduate": r"\b(graduate|post-?grad|postgraduate|master[’']?s\b|mba\b|m\.?\s*sc\.?\b|m\.?a\.?\b|ph\.?d|doktora|tez|yuksek\s+lisans|lisansustu|doctoral|doctorate)\b",
    "scholarship": r"\bscholar(ship|ships)?\b|\bburs(lar[ıi]?)?\b",
    "curriculum": r"\blessons?\b|\bcourses?\b|curriculum|modules?|\bects\b|syllabus|mufredat|ders|\bsemester\b|\bdonem\b",
    "multi_shell": r"\b(cur\s*sunit|cursunit|compare|comparison|vs\.?|versus|difference|fark|ikisi|her\s+iki|both\s+tracks?|two\s+programmes?|iki\s+program)\b",
    "first_year": r"first\s*-?\s*year|freshman|\b1st\s+year\b|year\s*1\b|birinci\s+sinif|1\.\s*sinif",
    "department_leader": r"head|chair|director|dean|baskan|dekan|mudur",
    "overview": r"\b(everything|all\s+(you\s+)?know|write\s+all|tell\s+me\s+(everything|all)|overview|summarize|summary|what\s+do\s+you\s+know|genel\s+bilgi|hepsini)\b",
}
_ABROAD = r"\b(international|foreign|yabanci|overseas)\b"
_APPLY = r"\b(apply|application|admissions?|basvuru|kabul|enroll|eligible|eligibility|requirements?|criteria)\b"
_APPLY_TOPIC = _APPLY + r"|\b(qualif|prerequisite|documents?)\b|what\s+do\s+(i|we)\s+need|who\s+can(not)?\s+apply"
_NEEDS = r"\b(requirements?|diplomas?|exams?|entrance|tests?|scores?|sat\b|gce|act\b|ap\b|tr-y|yos|tawjihi|baccalaur|abitur|matura|transcripts?|national\s+high\s+school|how\s+to\s+get\s+in)\b|what\s+do\s+(i|we)\s+need"
_PRICE = r"\b(tuition|ucret|fee|fees|how\s+much|price|prices|cost|payment|odeme)\b"

# Evidence in contents, titles and addresses; alternatives that fold to the same letters stand once.
FEE_HINT = r"fee|ucret|tuition|ogrenim|burs|scholarship|financial|pricing"
FEE_EVIDENCE = r"tuition|ucret|ogrenim|program\s+fee|annual\s+fee|\busd\b|\btry\b|₺|\$\s*[\d,\.]+|vat|kdv|yillik|taksit|per\s+year|/year|scholarship|burs|financial\s+aid|odeme|payment\s+plan|pesin"
SCHOLARSHIP_EVIDENCE = r"\bscholar(ship|ships)?\b|\bburs(lari?)?\b|discount|indirim|financial\s+aid"
LOW_VALUE = r"event|etkinlik|kariyer|career|duyur|announce|haber|news|kongre|congress|life-sciences|mezun|alumni|ilan|job|kampus\s*gez|graduate-fair|e-bulten|ebulten|tubitak"
ENTITY_NOISE = r"career|kariyer|event|etkinlik|news|haber|announcement|duyuru"
GRADUATE_SOURCE = r"graduate|post-?grad|yuksek\s*lisans|master[’'s]?\s*program|phd|doktora|/graduate/|/graduate-|\btez\b|mba\s*admission"
HIGH_SIGNAL = r"academic-staff|message-from-head|head-of-department|message\s+from\s+head|from\s+the\s+head|ode-to-the-department|bolum-baskan|bolum\s*baskan|department\s+head\s+message"
LOW_SIGNAL = r"commissions?\b|board-?of-?education|board_of_education|application[-\s]quotas|evaluation[-\s]schedule|quotas.*evaluation|have\s+been\s+announced|fall[-\s]semester.*20\d\d|academic[-\s]year.*announced|graduate\s+school\s+of\s+natural.*announc|klinik-arastirmalar|yogun-bakim|alumni[-_\s]videos|double[-\s]major|minor[-\s]program|accreditation[-\s]certificate"
LEADERSHIP_CONTENT = r"dean\s+of|faculty\s+dean|\bdean\b|dekan|rector|rektor|dean'?s?\s+office|vice\s*rector|yardimci\s*rektor|fakulte|faculty\s+of"
LEADER_CONTENT = r"head of department|message from head|department head|chair of|bolum baskan|dekan|mudur"
SMALL_TALK = r"^[\s!?.`,;'\"]*((hi|hello|hey|yo|hiya|sup|hola|howdy)(\s+(there|everyone|all|guys|team|baby|bro|dude|man))?|merhaba(\s+nasilsin)?|selam(\s+aleykum)?|\bsa\b|\bslm\b|\bnaber\b|good\s+(morning|afternoon|evening|night)(\s+there)?|how\s+are\s+you(\s+doing)?|what'?s\s+up|\bwassup\b|you\s+ok\?|what'?s\s+good|yo\s+what'?s\s+good|thanks?(\s+a\s+lot)?|thank\s+you(\s+so\s+much)?|\bthx\b|\bty\b|tesekkurler?|sag\s*ol|\bok\b|okay|tamam|\bbye\b|goodbye|see\s+you|gule\s+gule|\bbb\b|nice|cool|great|awesome|perfect|alright)[\s!?.`,;'\"]*$"
SMALL_TALK_NOT = r"\b(when|where|which|who|why|burs|scholar|tuition|fee|programs?|adres|address|basvuru|kampus|contact|iletisim|ucret|cret|apply|application|deadline|calendar|course|exam|graduate|undergraduate)\b|\bwhat\s+(is|are|was|were|does|did|do|can|should|about|if)\b|\bhow\s+(do|can|i|to|much|many|long|about|apply|register)\b"
OFF_TOPIC = r"\b(weather|forecast|hava\s*durumu|recipe|tarif|joke|fikra|espri|movie|film|music|muzik|song|sarki|game|oyun|football|futbol|basketball|basketbol|bitcoin|crypto|kripto|stock|borsa|diet|diyet|horoscope|burc|netflix|spotify|instagram|tiktok|who\s+is\s+elon|who\s+is\s+trump|who\s+is\s+biden|write\s+me\s+a\s+(poem|story|code|essay)|translate|cevir|what\s+time|saat\s+kac)\b"
OFF_TOPIC_NOT = r"\b(university|universite|campus|kampus|faculty|fakulte|program|department|bolum|student|ogrenci|admission|kayit|tuition|ucret|scholarship|burs)\b"

# Names of departments in both languages (folded), the words that point to a path, in order.
ENTITIES = {
    "computer-programming": ("computer programming", "computer programmer", "bilgisayar programciligi"),
    "computer-engineering": ("computer engineering", "bilgisayar muhendisligi"),
    "faculty-of-health-sciences": ("faculty of health sciences", "health sciences", "saglik bilimleri fakultesi"),
    "faculty-of-medicine": ("faculty of medicine", "medical school", "tip fakultesi", "hekimlik"),
}
PATHS = (
    ("faculty-of-health-sciences", ("faculty of health sciences", "health sciences", "health sciences faculty", "saglik bilimleri fakultesi", "saglik bilimleri")),
    ("faculty-of-medicine", ("faculty of medicine", "tip fakultesi", "hekimlik", "medical school", "doctor of medicine")),
    ("computer-programming", ("computer programming", "computer programmer", "bilgisayar programciligi", "programming")),
    ("computer-engineering", ("computer engineering", "bilgisayar muhendisligi", "muhendisligi bolum", "bolum bilgisayar")),
    ("electrical", ("electrical", "elektrik", "elektronik", "electronics")),
    ("mechanical", ("mechanical", "makine")),
    ("civil", ("civil", "insaat", "mimarlik insaat")),
    ("industrial", ("industrial", "endustri")),
    ("biomedical", ("biomedical", "biyomedikal", "biyom")),
    ("software", ("software", "yazilim", "yazilim m")),
)
# Terms that boost a question's candidates, by what it asks about.
STEM_TERMS = (
    (r"computer\s+programming|bilgisayar\s+programc", ("computer programming", "bilgisayar programciligi", "associate degree", "on lisans")),
    (r"computer|bilgisayar|informatics|yazilim|software", ("bilgisayar muhendisligi", "computer engineering")),
    (r"electrical|elektrik|elektronik|electronics", ("electrical", "elektrik", "electronics", "elektronik")),
    (r"mechanical|makine", ("mechanical", "makine")),
    (r"civil|insaat", ("civil", "insaat")),
)
STEM_DEFAULT = ("muhendisligi", "engineering", "faculty of engineering", "muhendislik")
LIST_TERMS = ("fakulte", "faculty", "department", "yuksekokul", "meslek yuksekokulu", "school of")


@dataclass(frozen=True)
class Site:
    """What is particular to one site: how it calls itself, names that stand for it, hosts, patterns of its course
    catalogue's addresses (the catalogue, a programme in it, its list and its matrix of courses), of headings that every
    page of the catalogue has and of pages that only introduce a department, and addresses that an entity's courses
    are looked for at first (entity, part of the address)."""

    name: str = "Example University"
    names: str = r"example\s+university"
    hosts: tuple[str, ...] = ("example.edu",)
    catalogue: str = r"/catalogue/|bologna|course"
    detail: str = r"showpac|cursunit=\d+|curunit=\d+"
    course_list: str = r"progcourses\.aspx"
    course_matrix: str = r"progcoursematrix\.aspx"
    headings: str = r"information package|program learning outcomes|course structure"
    intro: str = r"message from head of department|\babout \||faculty of engineering and natural sciences"
    preferred: tuple[tuple[str, str], ...] = ()


def has(text: Column, pattern: str, low: Callable[[Column], Column] = fold) -> Column:
    """Whether a pattern of this module occurs in the folded text (or what else low makes of it)."""
    return low(F.coalesce(text, F.lit(""))).rlike(pattern)


def intent(question: Column, name: str) -> Column:
    return once(fold(F.coalesce(question, F.lit(""))), lambda low: folded_intent(low, name))


def folded_intent(low: Column, name: str) -> Column:
    """The same of a question that is folded already."""
    if name == "international":
        return low.rlike(_ABROAD) & low.rlike(_APPLY_TOPIC) & ~(low.rlike(_PRICE) & ~low.rlike(_APPLY))
    if name == "requirements":
        return folded_intent(low, "international") & low.rlike(_NEEDS)
    if name == "undergraduate_only":
        return folded_intent(low, "international") & ~low.rlike(INTENTS["graduate"])
    if name == "wide_fee":
        return low.rlike(INTENTS["fee"]) & (low.rlike(INTENTS["broad_fee"]) | _segment(low).isNull())
    return low.rlike(INTENTS[name])


ALL_INTENTS = (*INTENTS, "international", "requirements", "undergraduate_only", "wide_fee")


def entity(question: Column) -> Column:
    """First entity one of whose names occurs; null if none does."""
    return once(fold(F.coalesce(question, F.lit(""))), folded_entity)


def folded_entity(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, names in reversed(ENTITIES.items()):
        out = F.when(contains_any(low, names), key).otherwise(out)
    return out


def path_segment(question: Column) -> Column:
    """Entity, else the first path whose words occur, else medicine where its price is asked."""
    return once(fold(F.coalesce(question, F.lit(""))), _segment)


def _segment(low: Column) -> Column:
    medicine = low.rlike(r"\bmedicine\b") & low.rlike(_PRICE) & ~low.rlike(r"medical\s+education|master[’']?s\s+in\s+medical|biomedic|laborator|techniques?|imaging|podolog|radiother|pathology|secretar|veterinary")
    out = F.when(medicine, "faculty-of-medicine")
    for segment, names in reversed(PATHS):
        out = F.when(contains_any(low, names), segment).otherwise(out)
    return F.coalesce(folded_entity(low), out)


def contains_any(low: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def aliases(key: Column) -> Column:
    """Names of an entity."""
    out = F.array().cast("array<string>")
    for k, names in ENTITIES.items():
        out = F.when(key == k, F.array(*map(F.lit, names))).otherwise(out)
    return out


def competitors(key: Column) -> Column:
    """Names of all other entities; none for no entity."""
    everything = [n for names in ENTITIES.values() for n in names]
    return F.when(key.isNull(), F.array().cast("array<string>")).otherwise(F.array_except(F.array(*map(F.lit, everything)), aliases(key)))


def stem_terms(question: Column) -> Column:
    low = fold(F.coalesce(question, F.lit("")))
    arrays = [F.when(low.rlike(p), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for p, terms in STEM_TERMS]
    found = F.when(low.rlike(STEM_TERMS[0][0]), arrays[0]).otherwise(F.array_distinct(F.concat(*arrays[1:])))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, STEM_DEFAULT)))
    return F.when(intent(question, "stem"), found).otherwise(F.array().cast("array<string>"))


def small_talk(message: Column) -> Column:
    t = F.trim(F.regexp_replace(fold(F.coalesce(message, F.lit(""))), r"\s+", " "))
    return (t != "") & (F.length(F.trim(F.coalesce(message, F.lit("")))) <= 160) & t.rlike(SMALL_TALK) & ~t.rlike(SMALL_TALK_NOT)


def off_topic(message: Column, site: Site = Site()) -> Column:
    t = fold(F.trim(F.coalesce(message, F.lit(""))))
    return (t != "") & (F.length(t) <= 300) & ~t.rlike(OFF_TOPIC_NOT) & ~t.rlike(site.names) & t.rlike(OFF_TOPIC)


def gate(message: Column, site: Site = Site()) -> Column:
    """What becomes of a message: small talk and other topics need no retrieval."""
    return F.when(small_talk(message), "small_talk").when(off_topic(message, site), "off_topic").otherwise("retrieve")


def fee_grounded(url: Column, title: Column, content: Column, low: Callable[[Column], Column] = fold, most: int | None = None) -> Column:
    """Whether the address or title names fees, or the whole text has evidence of them (of its first `most` characters, where a caller
    says so)."""
    head = F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")))
    body = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return has(head, FEE_HINT, low) | has(body if most is None else F.substring(body, 1, most), FEE_EVIDENCE, low)


def name_in(content: Column, name: Column) -> Column:
    """The folded name, or all of its words of two letters or more where it has two such words."""
    n = fold(F.trim(F.coalesce(name, F.lit(""))))
    parts = F.filter(F.split(n, r"\s+"), lambda p: F.length(p) >= 2)
    return once(fold(F.coalesce(content, F.lit(""))), lambda low: (n != "") & (F.contains(low, n) | ((F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(low, p)))))


def identity_allowed(url: Column, title: Column, content: Column, name: Column) -> Column:
    """For questions about a person: pages of little signal go, staff pages stay, others need the name."""
    head = F.concat_ws("\n", url, title)
    high, low = has(head, HIGH_SIGNAL), has(head, LOW_SIGNAL)
    return F.when(low & ~high, False).when(high, True).otherwise(name_in(F.concat_ws("\n", title, content), name))
