"""Word lists, patterns and messages that results depend on.

Everything in this file is data. It must stay equal to the published scoring
rules, in this order, because order decides which term is reported first.
Every list can be replaced by passing another one to the operator that uses it.
"""

# ---------------------------------------------------------------- resume text
# Verbs that count as action verbs, in report order.
ACTION_VERBS = [
    "achieved", "improved", "developed", "implemented", "managed", "created",
    "increased", "reduced", "led", "designed", "built", "optimized", "launched",
    "delivered", "executed", "established", "streamlined", "spearheaded",
    "automated", "collaborated", "coordinated", "directed", "engineered",
    "enhanced", "founded", "generated", "initiated", "integrated", "maintained",
    "operated", "planned", "programmed", "resolved", "supervised", "trained",
    "upgraded", "validated", "architected", "deployed", "facilitated",
    "migrated", "modernized", "orchestrated", "pioneered", "scaled",
    "accelerated", "drove", "transformed", "revamped", "overhauled",
]

# Technical skills, in report order.
TECHNICAL_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "c", "ruby", "php",
    "swift", "kotlin", "go", "rust", "scala", "r", "matlab", "perl", "haskell",
    "react", "angular", "vue", "vue.js", "node.js", "node", "express", "express.js",
    "django", "flask", "spring", "spring boot", "asp.net", "html", "html5", "css",
    "css3", "sass", "less", "bootstrap", "tailwind", "tailwindcss", "material-ui",
    "next.js", "next", "nuxt", "gatsby", "svelte", "backbone", "ember",
    "fastapi", "graphql", "rest", "restful", "soap", "grpc", "microservices",
    "serverless", "lambda", "api", "websocket",
    "sql", "mysql", "postgresql", "postgres", "mongodb", "redis", "sqlite",
    "oracle", "dynamodb", "cassandra", "elasticsearch", "mariadb", "neo4j",
    "firestore", "supabase", "firebase",
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s",
    "jenkins", "ci/cd", "terraform", "ansible", "vagrant", "git", "github",
    "gitlab", "bitbucket", "linux", "unix", "bash", "shell", "nginx", "apache",
    "machine learning", "deep learning", "data analysis", "data science",
    "artificial intelligence", "ai", "ml", "tensorflow", "pytorch", "keras",
    "scikit-learn", "sklearn", "pandas", "numpy", "jupyter", "matplotlib",
    "seaborn", "plotly", "tableau", "power bi", "spark", "hadoop", "airflow",
    "etl", "data mining", "nlp", "computer vision", "opencv",
    "android", "ios", "react native", "flutter", "xamarin", "ionic", "cordova",
    "objective-c", "java android",
    "testing", "unit testing", "selenium", "jest", "mocha", "chai", "pytest",
    "junit", "testng", "cypress", "puppeteer", "test automation", "tdd", "bdd",
    "agile", "scrum", "jira", "confluence", "trello", "slack", "figma", "sketch",
    "photoshop", "illustrator", "postman", "swagger", "webpack", "vite", "babel",
    "eslint", "prettier", "vim", "vscode", "intellij", "eclipse", "xcode",
    "version control", "source control", "git flow", "github actions", "travis ci",
    "circle ci", "gitlab ci",
    "blockchain", "ethereum", "solidity", "web3", "smart contracts", "cryptocurrency",
    "system design", "architecture", "design patterns", "oop", "functional programming",
    "event-driven", "message queue", "kafka", "rabbitmq", "redis pub/sub",
]

# Soft skills, reported after the technical ones.
SOFT_SKILLS = [
    "leadership", "communication", "teamwork", "problem solving", "analytical",
    "collaboration", "project management", "critical thinking", "mentoring",
    "presentation", "negotiation", "time management", "event management",
    "team management", "versatile", "trust building",
]

# A section is present when any of its words occurs anywhere.
SECTION_WORDS = {
    "experience": ["experience", "work history", "employment", "professional experience", "workexperience"],
    "education": ["education", "academic", "qualifications", "degree"],
    "skills": ["skills", "technical skills", "competencies", "abilities", "expertise"],
    "summary": ["summary", "objective", "profile", "about"],
    "projects": ["projects", "portfolio", "work samples"],
    "certifications": ["certifications", "certificates", "licenses"],
}
EXPECTED_SECTIONS = ["experience", "education", "skills", "summary"]

# Patterns for contact details.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_END = r"\d{3}[-.\s]?\d{4}"
LOCATIONS = [r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z][a-z]+)", r"([A-Z][a-z]+),\s*([A-Z]{2})"]
LINKEDIN = [r"linkedin\.com/in/([a-zA-Z0-9-]+)", r"linkedin:\s*@?([a-zA-Z0-9-]+)"]
GITHUB = [r"github\.com/([a-zA-Z0-9-]+)", r"github:\s*@?([a-zA-Z0-9-]+)"]
NOT_A_NAME = ["email", "phone", "linkedin", "github", "http", "@"]
NUMBER = r"\b\d+[%$,kmKMbB]?\b"

# What makes a bullet quantified (on the lower-cased bullet).
QUANTIFIED = [
    r"\d+\s*%",
    r"\d+\s*(percent|percentage)",
    r"\$\s*\d+",
    r"\d+[\d,]*\s*(million|thousand|billion|k|m|b)\b",
    r"\d+[\d,]*\+?\s*(users|customers|clients|people|participants|members|students|engineers)",
    r"\d+[\d,]*\s*(hours|days|weeks|months|years)",
    r"\d+[\d,]*\s*(projects|features|components|modules|systems|applications|apps)",
    r"\d+[\d,]*\s*(x|times)",
    r"(increased|decreased|reduced|improved|boosted|grew|raised|cut|saved|enhanced)\s+\w*\s*by\s*\d+",
    r"(over|more than|under|less than|up to)\s+\d+",
    r"\d+[\d,]*\s*(metrics|kpis|tickets|issues|bugs|tests)",
    r"\d+[\d,]*\s*(revenue|sales|profit|cost|budget)",
    r"from\s+\d+.*to\s+\d+",
]
BULLET_SIGNS = ["-", "•", "*", "◦", "▪"]

# Where the three parsed sections begin and end.
EDUCATION_START = ["education", "academic background", "qualifications"]
EDUCATION_END = ["work experience", "workexperience", "experience", "projects", "skills", "certifications"]
EXPERIENCE_START = ["workexperience", "work experience", "experience", "employment history", "professional experience"]
EXPERIENCE_END = ["summary", "projects", "skills", "certifications", "education"]
PROJECT_START = ["projects", "portfolio", "work samples", "key projects", "personal projects"]
PROJECT_END = ["education", "experience", "skills", "certifications", "languages", "links", "achievements", "summary"]
SECTION_MIN_LENGTH = 50

# Education patterns; all are matched without regard to case.
INSTITUTIONS = [
    r"(IIIT\s+[A-Z][a-z]+(?:,\s*[A-Z]{2,3})?)",
    r"(IIT\s+[A-Z][a-z]+)",
    r"(NIT\s+[A-Z][a-z]+)",
    r"([A-Z][A-Za-z\s]+(?:University|College|Institute|School)[^.\n]*)",
]
# Words without which the institution pattern of the same place cannot match.
INSTITUTION_HINTS = [["iiit"], ["iit"], ["nit"], ["university", "college", "institute", "school"]]
DEGREES = [
    r"\b(B\.?Tech|Bachelor|B\.?E\.?|B\.?S\.?)\b",
    r"\b(M\.?Tech|Master|M\.?E\.?|M\.?S\.?)\b",
    r"\b(Ph\.?D\.?|Doctorate)\b",
]
FIELDS_OF_STUDY = {
    "computer science": "Computer Science", "cse": "CSE", "electrical": "Electrical",
    "mechanical": "Mechanical", "civil": "Civil", "electronics": "Electronics",
    "information technology": "Information Technology", "data science": "Data Science",
    "ai": "Ai", "ml": "Ml",
}
DEFAULT_DEGREE, DEFAULT_FIELD = "B.Tech", "Computer Science"

# A month-year range such as "Jan 2020 - Present", any case.
MONTHS = ("Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|May|June|July"
          "|August|September|October|November|December")
MONTH_RANGE = (r"(" + MONTHS + r")\.?,?\s*\d{4}\s*[-–—]\s*(?:(" + MONTHS
               + r")\.?,?\s*\d{4}|Present|Current|present|current)")
# Date formats, first hit names the format.
DATE_FORMATS = {
    "month_year": r"[A-Z][a-z]{2,8},?\s+\d{4}",
    "mm_yyyy": r"\d{1,2}/\d{4}",
    "yyyy_mm": r"\d{4}-\d{2}",
    "year_only": r"\d{4}",
}
PROJECT_LINK_WORDS = ["http", "github", "gitlab", "link"]

# Wording checks.
TYPOS = [
    "teh ", "recieve", "occured", "seperate", "definately", "experiance", "responcible",
    "managment", "acheivement", "refered", "succesful", "profesional", "adress",
]
TARGETING_PHRASES = [
    "seeking", "looking for", "interested in", "pursuing", "specializing in", "focused on",
    "passionate about", "applying for", "position in", "role in",
]
LEADERSHIP_WORDS = [
    "led", "managed", "supervised", "coordinated", "directed", "organized", "mentored",
    "trained", "guided", "oversaw", "spearheaded", "championed", "founded", "established",
]
OPEN_SOURCE_WORDS = [
    "github.com", "open source", "oss", "pull request", "pr merged", "contributor",
    "maintainer", "open-source", "github repo",
]
PASSIVE_WORDS = ["was ", "were ", "been ", "being "]
SUMMARY_WORDS = ["summary", "objective", "profile"]
CERTIFICATES = [
    "aws certified", "google cloud certified", "microsoft certified", "cisco certified",
    "comptia", "pmp certified", "scrum master", "oracle certified", "red hat certified",
    "cfa", "cpa",
]

# Candidate level.
STUDENT_PHRASES = [
    "3rd year", "third year", "4th year", "fourth year", "undergraduate", "pursuing",
    "expected graduation", "currently studying", "student at", "bachelor's student",
    "master's student", "expected 202", "graduating 202",
]
STATED_YEARS = r"(\d+)\+?\s*years?\s+(?:of\s+)?experience"
YEAR_RANGE = r"(20\d{2})\s*[-–—]\s*(20\d{2}|present|current)"
SENIOR_WORDS = ["senior", "lead", "principal", "staff", "architect", "head of"]
MID_WORDS = ["associate", "mid-level", "mid level"]
ENTRY_WORDS = ["junior", "entry", "entry-level", "graduate", "intern", "trainee"]
SCORED_LEVELS = ["entry", "mid", "senior"]
CURRENT_YEAR = 2025

# The model resume, one sentence per quality (current and older scoring).
IDEAL_SENTENCES = [
    "professional summary showcasing expertise and career goals with measurable achievements",
    "work experience with quantified results showing impact percentages revenue growth and performance metrics",
    "technical skills including programming languages frameworks cloud platforms and development tools",
    "projects demonstrating hands-on experience with real-world applications and technologies",
    "education credentials with degree specialization institution and graduation details",
    "strong action verbs like developed implemented architected optimized managed and led",
    "contact information with email phone LinkedIn GitHub and professional profiles",
    "clear section organization with experience education skills projects and achievements",
    "bullet points highlighting specific accomplishments with numbers percentages and outcomes",
    "leadership collaboration and team management experience with measurable results",
]
IDEAL_SENTENCES_LEGACY = [
    "professional summary with clear career objectives and key achievements",
    "detailed work experience with quantifiable accomplishments and impact metrics",
    "comprehensive technical skills and competencies relevant to the role",
    "educational background with degrees certifications and relevant coursework",
    "strong action verbs describing responsibilities and achievements",
    "contact information including email phone and location",
    "clean formatting with clear section headers and bullet points",
]

# ------------------------------------------------------------------ job text
# Job seniority words, by rung.
JOB_INTERN = [
    "intern", "internship", "co-op", "co op", "trainee", "apprentice", "student", "undergraduate",
    "summer intern", "winter intern", "part-time intern", "research intern",
]
JOB_PRINCIPAL_TITLES = [
    "chief technology officer", "chief technical officer", "cto", "ceo", "cfo", "cio", "cpo", "cdo",
    "chief", "vp ", "vice president", "v.p.", "evp", "svp", "director of", "engineering director",
    "director", "head of", "group head", "department head", "managing director", "principal engineer",
    "principal developer", "principal software", "staff engineer", "staff developer", "staff software",
    "staff architect", "distinguished engineer", "fellow", "principal architect", "solutions architect",
    "enterprise architect", "chief architect", "principal consultant",
]
JOB_MANAGER_TITLES = ["engineering manager", "technical manager", "eng manager", "tech manager"]
JOB_ENTRY = [
    "entry-level", "entry level", "junior ", "jr. ", "jr ", "junior developer", "junior engineer",
    "junior software", "jr developer", "jr engineer", "graduate developer", "graduate engineer",
    "graduate programmer", "graduate software", "new grad", "recent graduate", "fresh graduate",
    "recent grad", "early career", "early in your career", "starting your career",
    "beginning of your career", "assistant developer", "assistant engineer", "assistant programmer",
    "level 1", "l1 ", " l1", "software engineer 1", "swe 1", "sde 1", "engineer 1", "developer 1",
]
JOB_ENTRY_NUMERAL, JOB_HIGHER_NUMERALS = " i ", [" ii", "iii", " iv"]
JOB_ENTRY_TITLES = ["junior", "jr.", "jr ", "entry", "graduate", "assistant"]
JOB_ENTRY_TITLE_EXCEPT = ["senior", "sr.", "sr ", "lead", "principal"]
JOB_TEACHING = [
    "learn on the job", "willingness to learn", "eager to learn", "we will teach", "we'll teach",
    "training provided", "mentorship provided", "with mentorship", "mentored by",
    "no experience required", "no prior experience",
]
JOB_SENIOR = [
    "senior ", "sr. ", "sr ", "senior developer", "senior engineer", "senior software", "sr developer",
    "sr engineer", "sr software", "lead engineer", "lead developer", "lead software", "lead programmer",
    "tech lead", "technical lead", "team lead", "architect", "software architect", "solution architect",
    "system architect", "application architect", "cloud architect", "data architect", "expert",
    "specialist", "senior specialist", "level 3", "level 4", "level 5", "level iii", "level iv",
    "level v", "l3 ", "l4 ", "l5 ", " l3", " l4", " l5", "software engineer 3", "software engineer 4",
    "software engineer 5", "swe 3", "swe 4", "swe 5", "sde 3", "sde 4", "sde 5", "engineer 3",
    "engineer 4", "engineer 5", "software engineer iii", "software engineer iv", "software engineer v",
    "sde iii", "sde iv", "sde v", "engineer iii", "engineer iv", "engineer v", "developer iii",
    "developer iv", "developer v", "senior consultant", "lead consultant",
]
JOB_MID = [
    "mid-level", "mid level", "intermediate", "mid-senior", "associate ", "associate engineer",
    "associate developer", "associate software", "analyst", "software analyst", "systems analyst",
    "level 2", " ii ", "level ii", "l2 ", " l2", "software engineer 2", "swe 2", "sde 2", "engineer 2",
    "developer 2", "engineer ii", "developer ii", "sde ii", "software engineer ii", "consultant",
    "technical consultant", "software consultant", "experienced developer", "experienced engineer",
]
JOB_YEARS_RANGE = r"(\d+)\s*(?:to|-)\s*(\d+)\s*years"
JOB_YEARS_PLUS = r"(\d+)\s*(?:\+|plus)\s*years"
JOB_YEARS = r"(\d+)\s*years"
JOB_YEARS_OPEN = r"(\d+)\+?\s*years"
JOB_DUTIES = {
    "principal": ["define architecture", "strategic", "company-wide", "cross-functional leadership"],
    "senior": ["mentor", "mentoring", "code review", "lead team", "technical decisions", "design systems",
               "architecture decisions"],
    "mid": ["collaborate", "work with team", "contribute to", "participate in"],
    "entry": ["learn", "training provided", "guidance", "support from senior", "shadowing"],
}
JOB_ROLE_TITLES = ["engineer", "developer", "programmer", "software"]
JOB_ROLE_MID_HINTS = ["looking for experienced", "5+ years", "strong background", "proven track record"]
JOB_ROLE_ENTRY_HINTS = ["recent graduate", "early career", "no experience", "will train"]

# Terms named in match reasons, most specific first.
MATCH_TERMS = [
    "react native", "spring boot", "next.js", "vue.js", "angular", "react", "node.js", "express.js",
    "django", "flask", "fastapi", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy",
    ".net core", "asp.net", "entity framework", "laravel", "symfony", "ruby on rails",
    "typescript", "javascript", "python", "java", "c#", "c++", "golang", "rust", "kotlin",
    "swift", "php", "ruby", "scala", "r", "matlab", "perl",
    "kubernetes", "docker", "jenkins", "terraform", "ansible", "aws", "azure", "gcp",
    "google cloud", "ci/cd", "gitlab", "github actions", "circleci",
    "postgresql", "mongodb", "mysql", "redis", "elasticsearch", "cassandra", "dynamodb",
    "sql server", "oracle", "sqlite", "mariadb",
    "machine learning", "deep learning", "natural language processing", "nlp", "computer vision",
    "neural networks", "transformers", "llm", "generative ai", "rag",
    "graphql", "rest api", "api", "microservices", "websockets", "grpc",
    "git", "linux", "unix", "bash", "powershell", "sql", "nosql",
    "agile", "scrum", "jira", "confluence",
]

# Skill categories of the job search, in query order. "languages"
# compares the whole skill, the others look for the word inside the skill.
SEARCH_CATEGORIES = {
    "high_value": ["full stack", "devops", "microservices", "api", "rest", "graphql"],
    "frameworks": ["react", "angular", "vue", "next.js", "next", "express", "express.js", "node.js", "node",
                   "django", "flask", "spring", "tailwind", "streamlit"],
    "languages": ["python", "java", "javascript", "typescript", "c", "c++", "rust", "go", "ruby", "php",
                  "kotlin", "swift"],
    "cloud": ["aws", "azure", "gcp", "docker", "kubernetes", "ci/cd", "github actions", "git", "github",
              "version control"],
    "databases": ["mysql", "postgresql", "mongodb", "supabase", "redis", "cassandra", "dynamodb", "sql"],
    "data_science": ["machine learning", "ai", "data science", "pandas", "numpy", "plotly", "tensorflow",
                     "pytorch", "scikit-learn"],
    "business": ["marketing", "sales", "business development", "strategy", "consulting", "finance",
                 "accounting", "economics", "operations", "supply chain"],
    "design": ["ui/ux", "graphic design", "product design", "figma", "sketch", "photoshop", "illustrator",
               "wireframing", "prototyping"],
    "management": ["agile", "scrum", "kanban", "pmp", "prince2", "stakeholder management",
                   "resource planning", "budget management"],
    "soft": ["leadership", "communication", "teamwork", "problem solving", "analytical", "collaboration",
             "project management", "critical thinking", "mentoring", "presentation", "negotiation",
             "time management", "event management", "team management", "versatile", "trust building",
             "strategic planning"],
}
EXACT_CATEGORY = "languages"
SOFT_CATEGORY, SOFT_LIMIT = "soft", 5
DEFAULT_SEARCH = "software developer"

# ------------------------------------------------------------------- scoring
# Fixed values: (at least, points) ladders; the first step reached counts.
HYBRID = {
    "sections": [(6, 5.0), (5, 4.0), (4, 3.0), (3, 1.5)],
    "skills_clarity": [(30, 6.0), (25, 5.0), (20, 4.0), (15, 2.5), (10, 1.0)],
    "hard_skills": [(25, 8.0), (20, 6.0), (15, 4.0), (10, 2.0)],
    "action_verbs": [(15, 5.0), (12, 4.0), (10, 3.0), (8, 2.0), (5, 1.0)],
    "quantification": [(0.5, 5.0), (0.4, 4.0), (0.3, 3.0), (0.2, 2.0), (0.15, 1.0)],
    "summary": [(30, 5.0), (20, 3.5), (10, 2.0)],
    "experience": {"entry": [(3, 8.0), (2, 6.0)], "mid": [(4, 8.0), (3, 6.0), (2, 3.0)],
                   "senior": [(5, 8.0), (4, 6.0), (3, 3.0)]},
    "projects": {"entry": [(5, 5.0), (4, 4.0), (3, 3.0), (1, 1.0)], "mid": [(3, 5.0), (2, 3.0), (1, 1.0)],
                 "senior": [(3, 5.0), (2, 3.0), (1, 1.0)]},
    "education_entry": [(3, 6.0), (2, 5.0), (1, 3.0)],
}
# Fixed values: (from, to, points) bands; the first band that contains the value counts.
BULLET_DENSITY = [(4, 5, 5.0), (3, 6, 4.0), (2, 7, 2.5), (1, None, 1.0)]
LENGTH_BANDS = {"entry": [(400, 800, 2.0), (300, 1000, 1.0)], "mid": [(600, 1000, 2.0), (500, 1200, 1.0)],
                "senior": [(800, 1200, 2.0), (600, 1400, 1.0)]}
BONUS_TAILORING, BONUS_LEADERSHIP, BONUS_OPEN_SOURCE = 2.0, 1.5, 0.5
PENALTY_CONTACT, PENALTY_DATES = -10.0, -5.0

# The older scoring.
LEGACY = {
    "sections": [(6, 5.0), (5, 4.0), (4, 3.0), (3, 1.5)],
    "experience": {"entry": [(3, 15.0), (2, 13.0)], "mid": [(4, 15.0), (3, 13.0), (2, 8.0), (1, 3.0)],
                   "senior": [(5, 15.0), (4, 12.0), (3, 7.0), (2, 2.0)]},
    "one_job_projects": [(5, 13.0), (4, 11.0), (3, 9.0), (0, 7.0)],
    "no_job_projects": [(5, 10.0), (4, 8.0), (3, 6.0), (0, 2.0)],
    "projects": {"entry": [(5, 8.0), (4, 7.0), (3, 5.0), (2, 3.0), (1, 1.0)],
                 "mid": [(4, 8.0), (3, 6.0), (2, 4.0), (1, 2.0)], "senior": [(3, 7.0), (2, 5.0), (1, 3.0)]},
    "action_verbs": [(15, 6.0), (12, 5.0), (10, 4.0), (8, 3.0), (6, 2.0), (4, 1.0)],
    "skills": [(25, 5.0), (20, 4.0), (15, 3.0), (10, 2.0), (6, 1.0)],
    "quantification": [(0.5, 7.0), (0.4, 6.0), (0.3, 5.0), (0.2, 4.0), (0.15, 3.0), (0.10, 2.0), (0.05, 1.0)],
    "numbers": [(10, 4.0), (7, 3.0), (5, 2.0), (3, 1.0)],
}
LEGACY_DENSITY = [(600, 800, 4.0), (500, 900, 3.0), (400, 1000, 2.0), (300, 1200, 1.0)]
LEGACY_BULLETS = {
    "entry": [(12, 15, 24.0), (10, 17, 20.0), (8, 19, 16.0), (6, 21, 12.0), (5, 23, 8.0), (4, None, 4.0)],
    "mid": [(20, 25, 24.0), (18, 28, 20.0), (15, 30, 16.0), (12, 32, 12.0), (10, 35, 8.0), (8, None, 4.0)],
    "senior": [(28, 35, 24.0), (25, 38, 20.0), (20, 40, 16.0), (18, 42, 12.0), (15, 45, 8.0), (12, None, 4.0)],
}

# Scoring without an encoder.
RULES = {
    "sections": [(5, 12.0), (4, 8.0), (3, 5.0)],
    "words": [(500, 800, 17.0), (450, 499, 14.0), (400, 449, 11.0), (350, 399, 7.0), (300, 349, 4.0),
              (0, 299, 2.0), (801, 1000, 14.0), (1001, 1200, 10.0)],
    "section_bonus": [(6, 12.0), (5, 9.0), (4, 6.0), (3, 3.0)],
    "verbs_and_numbers": [(15, 12, 12.0), (10, 8, 9.0), (6, 5, 6.0), (4, 3, 3.0)],
    "skills": [(25, 6.0), (15, 4.0), (10, 2.0)],
}

# Status of a score.
STATUS = [
    (85, "excellent", "Outstanding! Your resume is exceptionally well-optimized for ATS systems"),
    (75, "very-good", "Great! Your resume is very well-optimized for ATS systems"),
    (65, "good", "Good! Your resume is well-structured with minor improvements needed"),
    (55, "fair", "Fair - Your resume has good foundations but needs key improvements"),
    (45, "needs-improvement", "Needs improvement - Follow the recommendations to strengthen your resume"),
    (None, "poor", "Significant improvements needed - Focus on the top recommendations first"),
]
MATCH_LEVELS = [(80, "excellent"), (65, "very-good"), (50, "good"), (35, "fair"), (None, "poor")]
GOOD_MATCH = 50

# Similarity to points, as (at least, base, slope); below the last step: similarity * tail.
SNIPPET_CURVE, SNIPPET_TAIL = [(0.6, 75.0, 62.5), (0.4, 60.0, 75.0), (0.25, 45.0, 100.0)], 180.0
FULL_CURVE, FULL_TAIL = [(0.7, 70.0, 50.0), (0.5, 55.0, 75.0), (0.3, 35.0, 100.0)], 116.7
SNIPPET_WORDS = 100
SNIPPET_QUALITY_POINTS, FULL_QUALITY_POINTS = 10.0, 15.0

# Points lost when the job asks for more seniority than the candidate has.
SENIORITY_PENALTY = {
    "student": {"principal": 50.0, "senior": 40.0, "mid": 20.0},
    "intern": {"principal": 50.0, "senior": 40.0, "mid": 20.0},
    "entry": {"principal": 45.0, "senior": 35.0, "mid": 20.0},
    "mid": {"principal": 20.0, "senior": 5.0},
    "senior": {"principal": 5.0},
}

# Rule-based matching.
FRESHNESS = [(7, 15.0), (14, 12.0), (30, 8.0)]
FRESHNESS_REST, FRESH_DAYS = 4.0, 3
NO_SALARY = "Not specified"

# Job row defaults, list limits, file rule.
FEED_DEFAULTS = {"company": "Unknown", "salary": "Not specified", "job_type": "Full-time",
                 "experience_required": "Not specified"}
LIST_LIMIT, SEARCH_LIMIT, TOP_MATCHES = 100, 50, 20
MAX_FILE_BYTES = 5 * 1024 * 1024

# Resume format checks, in report order.
FORMAT_CHECKS = ["sufficientSkills", "hasProperSections", "hasContactInfo", "hasExperienceOrEducation",
                 "reasonableLength"]
FORMAT_CHECKS_NEEDED = 3
FORMAT_OK = "Valid resume format"
FORMAT_BAD = ("Invalid resume file. This appears to be a non-resume document (failed %d/5 format checks). "
              "Please upload a valid resume with your professional information.")

# Words that sort insights into qualities.
QUALITY_WORDS = ["good", "strong", "well", "excellent"]
DRAWBACK_WORDS = ["missing", "weak", "poor", "add", "improve"]

# Level of a candidate whose level is unknown, in matching.
DEFAULT_CANDIDATE_LEVEL = "entry"
