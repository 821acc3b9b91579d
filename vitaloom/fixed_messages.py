"""The wording of insights, advice and match reasons.

Everything in this file is data; ``%d`` and ``%s`` mark what is filled in.
"""

# Level labels.
LEVEL_LABELS = {"entry": "Entry-Level", "mid": "Mid-Level", "senior": "Senior-Level"}

# Insights.
HEADLINES = [
    (80, "Excellent %s resume optimization for ATS systems"),
    (70, "Very good %s resume structure with strong ATS compatibility"),
    (60, "Good %s resume structure with room for enhancement"),
    (50, "Decent %s resume foundation - follow recommendations to improve"),
    (None, "%s resume needs improvement - focus on the recommendations below"),
]
INSIGHT = {
    "contact": "Complete contact information present",
    "both_links": "Strong professional presence with LinkedIn and GitHub profiles",
    "one_link": "Professional profile link included",
    "degrees": "Multiple degrees listed (%d found)",
    "degree": "Educational background included",
    "jobs_3": "Rich work history with %d experiences",
    "jobs_2": "Good work history with %d experiences",
    "jobs_1": "Work experience included",
    "projects_3": "Strong project portfolio with %d projects",
    "projects_2": "Good project showcase with %d projects",
    "projects_1": "Project work demonstrated",
    "sections_5": "Well-structured with %d key sections",
    "sections_3": "Good structure with %d sections present",
    "verbs_10": "Excellent use of action verbs (%d found)",
    "verbs_5": "Good use of action verbs (%d found)",
    "numbers_5": "Strong quantification of achievements (%d metrics)",
    "numbers_3": "Good quantification of achievements (%d metrics)",
    "skills_10": "Comprehensive skill set (%d skills identified)",
    "skills_5": "Diverse skill set (%d skills identified)",
    "length_good": "Optimal resume length for ATS systems",
    "length_fair": "Acceptable resume length but could be more detailed",
}

# Advice.
ADVICE = {
    "name": "📛 Add your full name at the top of your resume",
    "links_entry": "🔗 Add LinkedIn profile (essential) or GitHub (if technical)",
    "links": "🔗 Add LinkedIn and GitHub profiles to strengthen professional presence",
    "email": "⚠️ Add your email address at the top of your resume",
    "phone": "⚠️ Add your phone number for easy contact",
    "education": "🎓 Add an Education section with your degree, institution, and graduation year",
    "institution": "🎓 Include the name of your educational institution",
    "degree": "🎓 Specify your degree/major in the Education section",
    "degree_senior": "🎓 Consider adding advanced degrees or certifications if applicable",
    "entry_jobs_0": "💼 Add internships, volunteer work, or part-time jobs to demonstrate experience",
    "entry_jobs_0_projects": "🚀 Include 3-4 substantial projects to compensate for limited work experience",
    "entry_jobs_1": "💼 Add more internships or part-time experiences if available",
    "mid_jobs_0": "⚠️ CRITICAL: Mid-level positions require 2-3 years work experience - add all relevant roles",
    "mid_jobs_1": "💼 Add more work experiences - mid-level roles typically require 2-3 positions",
    "mid_jobs_2": "💼 Consider adding additional relevant experiences to strengthen your profile",
    "senior_jobs_few": "⚠️ CRITICAL: Senior positions require 3+ work experiences showing career progression",
    "senior_jobs_3": "💼 Consider adding more experiences to demonstrate extensive background (4+ is ideal)",
    "entry_projects_0": "🚀 CRITICAL: Add 3-4 projects to demonstrate your skills (essential for entry-level)",
    "entry_projects_1": "🚀 Add more projects (aim for 3-4) - crucial for entry-level candidates",
    "entry_projects_2": "🚀 Add 1-2 more projects to strengthen your portfolio",
    "mid_projects_0": "🚀 Add 2-3 projects to demonstrate continued skill development",
    "mid_projects_1": "🚀 Add more projects to showcase diverse skills and initiative",
    "senior_projects_0": "🚀 Consider adding 1-2 notable projects or technical leadership examples",
    "entry_bullets_low": "📝 Add more bullet points (currently %d, aim for 12-20 for entry-level)",
    "entry_bullets_fair": "� Add a few more details (currently %d, aim for 15-20)",
    "mid_bullets_low": "📝 Add more accomplishment bullets (currently %d, aim for 20-30 for mid-level)",
    "mid_bullets_fair": "📝 Expand your accomplishments (currently %d, aim for 25-30)",
    "senior_bullets_low": "📝 Add more detailed accomplishments (currently %d, aim for 30-35+ for senior-level)",
    "senior_bullets_fair": "📝 Expand on your leadership impact (currently %d, aim for 35+)",
    "section": "📝 Add a '%s' section to improve structure",
    "repeated": "🔄 Replace repetitive '%s' verb (used %d times) - use it max 2 times",
    "verbs_low": "💪 Use more action verbs (achieved, developed, implemented, led, etc.) to strengthen impact",
    "verbs_fair": "💪 Add more action verbs to better showcase your achievements",
    "quantified_low": ("📊 Only %d of %d bullets are quantified - add numbers to at least 50%% "
                       "(e.g., 'Increased sales by 30%%')"),
    "quantified_fair": ("📊 Quantify more bullets: %d/%d have metrics - aim for 50%%+ "
                        "(add %%, $, or specific numbers)"),
    "quantified_good": "📊 Good quantification (%d/%d) - try to add metrics to a few more bullets",
    "numbers_low": "📊 Add quantifiable metrics (%, $, numbers) to demonstrate impact",
    "numbers_fair": "📊 Include more specific numbers and percentages to quantify your achievements",
    "words_200": "📄 Your resume is too short - add more details about your experience, achievements, and impact",
    "words_300": "📄 Expand your resume with more specific examples and details (aim for 400-700 words)",
    "words_400": "📄 Consider adding more details about your responsibilities and achievements",
    "words_1200": "✂️ Your resume is too long - condense to 2 pages maximum (600-900 words)",
    "words_900": "✂️ Consider condensing slightly for better readability (aim for 600-900 words)",
    "skills_low": "🔧 List more relevant technical and soft skills (e.g., programming languages, tools, frameworks)",
    "skills_fair": "🔧 Expand your skills section with more specific technologies and competencies",
    "score_low": ("⭐ Focus on adding quantifiable achievements and action verbs first - these have the biggest "
                  "impact"),
    "score_fair": ("⭐ Your resume foundation is good - focus on quantifying achievements and adding specific "
                   "results"),
    "bullets": "✨ Use bullet points to make your resume easier to scan by ATS systems",
}

# Reasons given for a match.
GAP_REASONS = [
    (30, "⚠️ This is a %s-level position, but you're %s-level - significant experience gap"),
    (15, "⚠️ This %s-level role may require more experience than you have (%s-level)"),
    (5, "This is a %s-level position - you may need to stretch to meet requirements"),
]
GAP_QUALITY_FROM = 20
GAP_QUALITY = [
    (65, "Good skills match, but position requires more experience"),
    (50, "Moderate match - carefully review if you meet minimum requirements"),
    (35, "Limited match - significant experience gap may disqualify"),
    (None, "Not recommended - this role is beyond your current experience level"),
]
QUALITY = [
    (80, "Excellent match - highly recommended to apply"),
    (65, "Very good match for your profile"),
    (50, "Good match - worth applying"),
    (35, "Moderate match - review requirements carefully"),
    (None, "Limited match - may not be the best fit"),
]
SIMILARITY_REASONS = [
    (0.7, "Strong semantic alignment between your resume and job requirements"),
    (0.5, "Moderate alignment with job requirements"),
]
RESUME_QUALITY_REASONS = [
    (80, "Your resume is well-optimized for ATS systems"),
    (60, "Good resume quality supports your application"),
]
SKILL_REASON = "Matching skills: "
KEYWORD_REASON = "Keyword overlap: %d common terms"
RULE_REASONS = [
    (80, "Excellent match for your skills and experience"),
    (60, "Good match for your profile"),
    (40, "Moderate match - consider applying"),
]
RULE_SKILL_REASON = "Matches your skills: "
RULE_FRESH_REASON = "Recently posted - apply quickly!"
