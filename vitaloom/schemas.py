"""Fixed schemas of the tables and of the job feed."""

from pyspark.sql import types as T

LONG, TEXT, TIME, FLAG, BYTES = T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType(), T.BinaryType()
SCORE, TEXTS = T.DecimalType(5, 2), T.ArrayType(T.StringType())


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


USERS = _struct(id=LONG, username=TEXT, email=TEXT, created_at=TIME, last_login=TIME)
RESUMES = _struct(id=LONG, user_id=LONG, file_name=TEXT, file_path=TEXT, text=TEXT, pdf_content=BYTES, upload_date=TIME,
                  is_latest=FLAG, status=TEXT, analysis=TEXT, created_at=TIME, updated_at=TIME)
JOBS = _struct(id=LONG, title=TEXT, company=TEXT, location=TEXT, description=TEXT, url=TEXT, posted_date=TIME,
               salary=TEXT, tags=TEXTS, source=TEXT, experience_required=TEXT, job_type=TEXT, is_active=FLAG,
               created_at=TIME, updated_at=TIME)
JOB_APPLICATIONS = _struct(id=LONG, user_id=LONG, job_id=LONG, resume_id=LONG, status=TEXT, match_score=SCORE,
                           applied_date=TIME, notes=TEXT, created_at=TIME, updated_at=TIME)
JOB_RECOMMENDATIONS = _struct(id=LONG, user_id=LONG, resume_id=LONG, job_id=LONG, match_score=SCORE,
                              recommendation_reasons=TEXTS, created_at=TIME)
FEED_JOB = _struct(title=TEXT, location=TEXT, snippet=TEXT, salary=TEXT, source=TEXT, type=TEXT, link=TEXT,
                   updated=TEXT, company=TEXT, id=TEXT)
FEED = _struct(totalCount=LONG, jobs=T.ArrayType(FEED_JOB))

TABLES = {"users": USERS, "resumes": RESUMES, "jobs": JOBS, "job_applications": JOB_APPLICATIONS,
          "job_recommendations": JOB_RECOMMENDATIONS}
