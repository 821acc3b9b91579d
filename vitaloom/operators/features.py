"""Text to features: one narrow stage, no shuffle, no Python."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions import bullets, contact, levels, quality, sections, vocabulary
from vitaloom.functions.text import has_text, tokens, word_count


def require_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Flag rows that have text; rows without are kept with ``success = false``."""
    return df.withColumn("success", has_text(F.col(text)))


def extract_features(df: DataFrame, text: str = "text", verbs=None, skills=None, section_words=None,
                     as_of_year: int = fixed.CURRENT_YEAR) -> DataFrame:
    """Add the feature columns of a text column.

    The layers keep shared inputs (lower-cased text, bullets, sections) in their
    own projection, so each is computed once per row.
    """
    t, low = F.col(text), F.col("_low")
    base = df.withColumns({"_low": F.lower(t), "_bullets": bullets.split_bullets(t), "word_count": word_count(t)})
    cut = base.withColumns({
        "_words": tokens(low),
        "_education": sections.education_section(t, low), "_experience": sections.experience_section(t, low),
        "_projects": sections.project_section(t, low),
        "total_bullets": F.size("_bullets"), "quantified_bullets": bullets.quantified_bullets(F.col("_bullets")),
        "email": contact.extract_email(t), "phone": contact.extract_phone(t)})
    return cut.withColumns({
        "name": contact.extract_name(t),
        "has_contact": F.col("email").isNotNull() & F.col("phone").isNotNull(),
        "location": contact.extract_location(t), "linkedin": contact.extract_linkedin(t),
        "github": contact.extract_github(t), "sections": vocabulary.find_sections(low, section_words),
        "education": sections.extract_education(F.col("_education")),
        "work_experience": sections.extract_experience(F.col("_experience")),
        "projects": sections.extract_projects(F.col("_projects")),
        "action_verb_frequency": vocabulary.action_verb_frequency(low, verbs, F.col("_words")),
        "numbers": vocabulary.find_numbers(t), "skills": vocabulary.find_skills(low, skills, F.col("_words")),
        "_level": levels.detect_level(low, F.col("total_bullets"), as_of_year),
        "layout": quality.analyze_layout(t), "grammar_points": quality.grammar_score(t, low),
        "tone_points": quality.tone_score(t, low, F.col("word_count")), "summary_points": quality.summary_score(t, low),
        "certification_points": quality.certifications_score(low), "tailored": quality.detect_tailoring(low),
        "leads": quality.detect_leadership(low), "open_source": quality.detect_oss(low),
    }).withColumns({
        "action_verbs": F.map_keys("action_verb_frequency"),
        "repetitive_verbs": vocabulary.repetitive_verbs(F.col("action_verb_frequency")),
        "experience_level": F.col("_level.level"), "years_of_experience": F.col("_level.years"),
        "dates": quality.date_consistency(F.col("work_experience"), F.col("education")),
    }).drop("_low", "_bullets", "_words", "_education", "_experience", "_projects", "_level")
