"""Fixed dimensions of the analysis: rules, watched phrases, behaviour markers, strategies, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Signature, languages (both, en, zh), severity (- where no rule is published), W where weak alone, T where a target-voice rule.
RULES = """
structural.negation_contrast both 4
structural.one_line_closer both 4
structural.staged_runup both 4
structural.staged_candor both 3
structural.arguing_with_no_one both 4
structural.inflated_significance both 4
structural.stock_challenges_outlook both 4
structural.universal_positive_ending both 3
structural.heading_restated both 3
structural.writes_about_previous_version en 3
structural.abstract_verb_swallows_action zh 3
structural.false_range both 3
structural.formulaic_construction en 3
structural.narrator_from_a_distance en 4
structural.enumeration_padding zh 4
structural.opening_body_ending_disconnect zh 4
structural.article_level_rewrite_template zh 3
structural.extreme_conclusion both 3
rhythm.forced_triad both 3
rhythm.repeated_openings both 3
rhythm.dash_overuse both 4
rhythm.uniform_rhythm both 4
rhythm.comma_splice_rhythm en 2
rhythm.negative_listing en 3
lexical.ai_vocabulary both 3
lexical.aphorism_dressing both 4
lexical.stacked_qualifiers both 3 W
lexical.vague_attribution both 4
lexical.ing_trailers en 4
lexical.sales_language both 4
lexical.borrowed_authority both 4
lexical.copula_avoidance both 3
lexical.synonym_rotation both 3
lexical.filler_phrase both 3
lexical.restatement both 2
lexical.telling_not_showing en 2
lexical.business_jargon en 4
lexical.adverb_filler en 2
lexical.lazy_extremes en -
lexical.meta_commentary en 3
lexical.emphasis_crutch en 2
lexical.vague_declarative en 3
lexical.false_agency en 3
lexical.rhetorical_setup en 2
lexical.passive_and_subjectless both 2 W
lexical.wordy_connectives en 2
lexical.low_lexical_diversity en 2
lexical.translationese_connective zh 4
lexical.provider_tic en 2
formatting.bold_decoration both 3
formatting.bold_label_list both 3
formatting.decorative_headings both 3
formatting.hyphenated_pairs en 3 W
formatting.curly_quotes both 2 W
formatting.quote_convention both -
formatting.emoji_decoration both 3
formatting.exclamation_spam both 2
formatting.excessive_structure both 2
formatting.smart_punctuation_leak both 2
formatting.numbered_section_markers both 2
assistant.chatbot_residue both 5
assistant.knowledge_limit_disclaimer both 5
assistant.sycophancy both 3
assistant.rlhf_artifacts en 4
assistant.reasoning_chain_leak en 4
assistant.acknowledgment_loop en 3
assistant.conclusion_fluff en 3
assistant.llm_artifact_leak both 5
assistant.unsolicited_advice both -
chat.mirrors_user both 4
chat.over_agreement both 3
chat.unsolicited_advice both 4
chat.auto_summary both 3
chat.unsolicited_offer both 4
chat.over_completeness both 4
chat.explains_obvious both 3
chat.forced_positivity both 3
chat.mechanical_empathy both 4
chat.unrequested_background both 3
chinese.result_clause_stacking zh -
chinese.idiom_stacking zh 3
chinese.officialese zh 4
chinese.punctuation_width zh 3
chinese.boilerplate_phrase zh 2
chinese.noteworthy_filler zh -
chinese.translationese zh 3
chinese.punctuation_convention zh 3
chinese.terminology_consistency zh 3
stylometry.distribution_distance both 3 T
stylometry.fingerprint_sentence_length both 3 T
stylometry.fingerprint_punctuation both 2 T
stylometry.fingerprint_vocabulary both 3 T
"""

# Rule, then its watched phrases, parted by bars; T: marks templates.
PHRASES = """
assistant.chatbot_residue|Certainly!|Great question!|Of course!
assistant.conclusion_fluff|T:in conclusion|T:in summary|T:to sum up
lexical.adverb_filler|fundamentally|actually|honestly|importantly|inherently|interestingly
lexical.ai_vocabulary|additionally|furthermore|emphasizing|encompassing|fostering|highlighting|in the realm of|showcasing|underscoring|utilize|facilitate|comprehensive|subsequently|demonstrate|implement|leverage|optimize|paradigm|methodology|innovative|streamline|unprecedented|transformative|ecosystem|scalable|robust|delve|intricate|pivotal|encompasses|multifaceted|realm|commendable|meticulous|paramount|underscore
lexical.aphorism_dressing|at its core|in reality|the real question is|归根结底|说到底
lexical.business_jargon|deep dive|game-changer|landscape|paradigm shift|synergy|unpack
lexical.copula_avoidance|boasts
lexical.restatement|in other words,|换句话说，
lexical.sales_language|best-in-class|breathtaking|cutting-edge|enhancing|groundbreaking|must-visit|nestled|next-generation|renowned|revolutionize|stunning|unlock the potential|vibrant|world-class|引领
lexical.stacked_qualifiers|essentially
lexical.translationese_connective|值得注意的是|T:与此同时，|从某种意义上说|毋庸置疑
lexical.vague_attribution|it is believed that|experts argue|industry reports
lexical.wordy_connectives|At the end of the day|In a world where|It's worth noting|When it comes to|T:in essence,|it is important to|T:moreover,|on the other hand|T:ultimately,
structural.abstract_verb_swallows_action|赋能|底层逻辑|抓手|闭环
structural.arguing_with_no_one|to be clear
structural.enumeration_padding|T:其次，|T:最后，
structural.inflated_significance|setting the stage for|the future looks bright
structural.negation_contrast|T:not X but Y
structural.one_line_closer|"Let that sink in."
structural.staged_runup|here's the thing|needless to say
"""

# Words too common to be watched.
TOO_COMMON = "the and or but so very really just also key deep look well even only much many more most some such then than that this with from have has had not now out all any can may might"
TOO_COMMON_CJK = "大概率 这件事"

# Behaviour, severity, scoring class.
SMELLS = """
chat.mirrors_user 4 deprecated-candidate
chat.over_agreement 3 discriminating
chat.unsolicited_advice 4 shadow
chat.auto_summary 3 descriptive
chat.unsolicited_offer 4 shadow
chat.over_completeness 4 descriptive
chat.explains_obvious 3 deprecated-candidate
chat.forced_positivity 3 discriminating
chat.mechanical_empathy 4 discriminating
chat.unrequested_background 3 shadow
"""

# Markers of each behaviour; ^ where one must open a clause.
MARKERS = """
chat.mirrors_user zh 你提到|你说的是|正如你所说|据你所说
chat.mirrors_user en you mentioned|you said that|as you noted|based on what you described|you are asking about
chat.over_agreement zh ^确实|^没错|^说得对|^完全同意|^你说得很对
chat.over_agreement en ^absolutely|^exactly|you are absolutely right|^you are right|that is a great point
chat.unsolicited_advice zh 建议你|你可以试试|不妨|记得|最好是
chat.unsolicited_advice en it is worth|it's worth|you may want to|you might want to|consider |make sure to
chat.auto_summary zh 总之|总的来说|总结一下|综上所述|综上
chat.auto_summary en in summary|in short|to sum up|to summarise|to summarize|in conclusion|all in all
chat.unsolicited_offer zh 还有什么可以帮你|如果还有问题|随时告诉我|欢迎随时问我|希望这些对你有帮助|需要我再
chat.unsolicited_offer en let me know if|hope this helps|hope that helps|feel free to ask|would you like me to|want me to|should i continue
chat.over_completeness zh ^一方面|^另一方面|^需要注意的是
chat.over_completeness en ^on the one hand|^on the other hand|^there are several|^it depends on
chat.explains_obvious zh 所谓|意思是指|简单来说|换句话说
chat.explains_obvious en in other words|that is to say|which means that|simply put|to put it another way
chat.forced_positivity zh 很棒|厉害|加油|你已经做得很好|这个想法很好
chat.forced_positivity en great question|excellent question|that is a great|that's a great|you have got this|well done
chat.mechanical_empathy zh 我理解你的感受|我理解你的心情|这确实让人很沮丧|听起来你|能理解你的难处
chat.mechanical_empathy en i understand how you feel|i understand how frustrating|that sounds really|it sounds like you are going through|i can imagine how
chat.unrequested_background zh 值得一提的是|值得注意的是|顺便说一下|需要说明的是|背景是这样的|补充一点|从另一个角度来看|从另一个角度看|换个角度看|从更宏观的角度|这背后其实反映了|往往就藏在
chat.unrequested_background en it is worth noting|it's worth noting|worth mentioning|by the way|bear in mind that|for context|looking at the bigger picture|on a broader level
"""

# Families whose findings are prose, and those of each ablation configuration.
PROSE_FAMILIES = ("structural", "rhythm", "lexical", "chinese", "english", "stylometry")
CONFIGS = """
baseline|
anti-ai|structural,rhythm,lexical,chinese,english
voice|stylometry
behavior|assistant
anti-ai+voice|structural,rhythm,lexical,chinese,english,stylometry
anti-ai+behavior|structural,rhythm,lexical,chinese,english,assistant
full|structural,rhythm,lexical,chinese,english,stylometry,assistant
"""


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x]


def rules() -> list[dict]:
    """Published rules: id, category, languages, severity, weak_alone, tags."""
    out = []
    for line in _lines(RULES):
        rule, langs, severity, *marks = line.split(" ")
        if severity != "-":
            out.append({"rule_id": rule, "category": rule.split(".")[0], "languages": ["en", "zh"] if langs == "both" else [langs], "severity": int(severity), "weak_alone": "W" in marks, "tags": ["voice"] if "T" in marks else []})
    return out


def severity(rule: str) -> int | None:
    """Severity of a published rule, None if there is no such rule."""
    return next((r["severity"] for r in rules() if r["rule_id"] == rule), None)


def phrases() -> list[dict]:
    """Watched phrases: rule_id, text, kind, note."""
    out = []
    for line in _lines(PHRASES):
        rule, *texts = line.split("|")
        out += [{"rule_id": rule, "text": t.removeprefix("T:"), "kind": "template" if t.startswith("T:") else "literal", "note": None} for t in texts]
    return out


def smells() -> dict[str, tuple[int, str]]:
    return {a: (int(b), c) for a, b, c in (x.split(" ") for x in _lines(SMELLS))}


def markers() -> dict[str, dict[str, list[str]]]:
    """Markers by behaviour and language."""
    out: dict[str, dict[str, list[str]]] = {}
    for line in _lines(MARKERS):
        smell, lang, texts = line.split(" ", 2)
        out.setdefault(smell, {})[lang] = texts.split("|")
    return out


def configs() -> dict[str, list[str]]:
    """Families that run under each configuration."""
    return {a: [x for x in b.split(",") if x] for a, b in (x.split("|") for x in _lines(CONFIGS))}


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule_id string, category string, languages array<string>, severity int, weak_alone boolean, tags array<string>")


def phrases_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(phrases(), "rule_id string, text string, kind string, note string")


def configs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([{"config_id": k, "families": v} for k, v in configs().items()], "config_id string, families array<string>")
