"""Tables, patterns and thresholds that results depend on. Data only."""

from __future__ import annotations

# File extension to loader type.
FILE_TYPES = {
    ".pdf": "pdf", ".txt": "text", ".text": "text", ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".docx": "docx", ".doc": "docx",
    ".pptx": "pptx", ".ppt": "pptx", ".xlsx": "xlsx", ".xls": "xlsx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tiff": "image",
    ".tif": "image", ".bmp": "image", ".gif": "image", ".html": "html", ".htm": "html",
}

# Excerpt and chunk sizes, in characters; caps in words.
EXCERPT, CHUNK, CHUNK_OVERLAP, CAP_WORDS, CAP_WORDS_FIELDS = 600, 6000, 500, 1000, 500

# Fields that a document of each type must have, and all fields of its schema.
REQUIRED_FIELDS = {
    "financial_document": ["total_amount", "issuer_name", "document_date", "document_number", "recipient_name"],
    "resume": ["candidate_name", "email", "phone", "work_experience", "education"],
    "job_offer": ["candidate_name", "position_title", "salary", "start_date", "company_name"],
    "medical_record": ["patient_name", "date_of_birth", "diagnosis", "physician_name", "visit_date"],
    "id_document": ["full_name", "document_number", "date_of_birth", "issue_date", "expiration_date"],
    "academic": ["student_name", "institution_name", "degree_program", "graduation_date", "gpa"],
    "unknown": ["title", "date", "author"],
}
SCHEMA_FIELDS = {
    "financial_document": ["document_number", "document_date", "due_date", "issuer_name", "issuer_address", "recipient_name", "recipient_address", "total_amount", "tax_amount", "currency", "payment_method", "line_items"],
    "resume": ["candidate_name", "email", "phone", "address", "linkedin_url", "summary", "education", "work_experience", "skills", "certifications", "languages"],
    "job_offer": ["candidate_name", "company_name", "position_title", "offer_date", "start_date", "salary", "employment_type", "work_location", "department", "reporting_to", "benefits", "conditions", "deadline_to_accept"],
    "medical_record": ["patient_name", "patient_id", "date_of_birth", "visit_date", "physician_name", "department", "diagnosis", "prescribed_medications", "lab_results", "follow_up_date", "notes"],
    "id_document": ["document_type", "document_number", "full_name", "date_of_birth", "gender", "nationality", "place_of_birth", "address", "issue_date", "expiration_date", "issuing_authority"],
    "academic": ["document_type", "student_name", "student_id", "institution_name", "degree_program", "graduation_date", "gpa", "doi", "courses", "honors"],
    "unknown": ["title", "author", "date", "summary", "key_entities", "key_dates", "key_amounts"],
}

# Other names of fields and the canonical name of each, in the order in which they fill a field.
ALIASES = {
    "position": "position_title", "job_title": "position_title", "title": "position_title", "role": "position_title", "job_role": "position_title",
    "company": "company_name", "employer": "company_name", "organization": "company_name", "candidate": "candidate_name", "applicant_name": "candidate_name",
    "employee_name": "candidate_name", "annual_salary": "salary", "base_salary": "salary", "compensation": "salary", "location": "work_location",
    "office_location": "work_location", "job_location": "work_location", "manager": "reporting_manager", "supervisor": "reporting_manager", "reports_to": "reporting_manager",
    "expiration": "offer_expiration_date", "valid_until": "expiration_date", "name": "candidate_name", "full_name": "candidate_name", "applicant": "candidate_name",
    "contact_email": "email", "email_address": "email", "phone_number": "phone", "contact_phone": "phone", "mobile": "phone",
    "professional_summary": "summary", "objective": "summary", "profile": "summary", "technical_skills": "skills", "skill_list": "skills",
    "competencies": "skills", "experience": "work_experience", "employment_history": "work_experience", "educational_background": "education", "academic_history": "education",
    "patient": "patient_name", "patient_full_name": "patient_name", "dob": "date_of_birth", "birth_date": "date_of_birth", "birthdate": "date_of_birth",
    "mrn": "medical_record_number", "patient_id": "medical_record_number", "doctor": "physician_name", "provider": "physician_name", "attending_physician": "physician_name",
    "visit": "visit_date", "appointment_date": "visit_date", "encounter_date": "visit_date", "condition": "diagnosis", "medical_condition": "diagnosis",
    "prescriptions": "medications", "drugs": "medications", "meds": "medications", "vitals": "vital_signs", "vital_statistics": "vital_signs",
    "amount": "total_amount", "total": "total_amount", "grand_total": "total_amount", "issuer": "issuer_name", "vendor": "issuer_name",
    "supplier": "issuer_name", "recipient": "recipient_name", "customer": "recipient_name", "client": "recipient_name", "invoice_number": "document_number",
    "receipt_number": "document_number", "doc_number": "document_number", "date": "document_date", "invoice_date": "document_date", "receipt_date": "document_date",
    "tax": "tax_amount", "vat": "tax_amount", "sales_tax": "tax_amount", "student": "student_name", "student_full_name": "student_name",
    "school": "institution_name", "university": "institution_name", "college": "institution_name", "program": "degree_program", "major": "degree_program",
    "field_of_study": "degree_program", "grad_date": "graduation_date", "completion_date": "graduation_date", "grade_point_average": "gpa", "cumulative_gpa": "gpa",
    "textbook_title": "title", "book_title": "title", "book_name": "title", "writer": "author", "authors": "author",
    "isbn_10": "isbn", "isbn_13": "isbn", "published_year": "publication_year", "year_published": "publication_year", "publication_date": "publication_year",
    "id_number": "document_number", "passport_number": "document_number", "license_number": "document_number", "issued": "issue_date", "issued_date": "issue_date",
    "expires": "expiration_date", "expiry_date": "expiration_date",
}
# Fields that are one text; of a list the first element that says something counts.
SCALAR_FIELDS = [
    "email", "phone", "candidate_name", "full_name", "date_of_birth", "issue_date", "expiration_date", "document_number",
    "summary", "patient_name", "physician_name", "visit_date", "diagnosis", "issuer_name", "recipient_name", "document_date",
    "total_amount", "position_title", "company_name", "salary", "start_date",
]

# Labels of document types in the order in which they are tried, by type.
TYPE_LABELS = {
    "cv": "resume", "curriculum vitae": "resume", "job application": "resume", "biodata": "resume", "job offer": "job_offer",
    "offer letter": "job_offer", "employment offer": "job_offer", "internship offer": "job_offer", "appointment letter": "job_offer", "financial": "financial_document",
    "invoice": "financial_document", "receipt": "financial_document", "gst invoice": "financial_document", "tax invoice": "financial_document", "bill": "financial_document",
    "medical": "medical_record", "health record": "medical_record", "prescription": "medical_record", "lab report": "medical_record", "id": "id_document",
    "identification": "id_document", "passport": "id_document", "driver license": "id_document", "aadhaar": "id_document", "aadhar": "id_document",
    "pan card": "id_document", "id card": "id_document", "id_document": "id_document", "college id": "id_document", "college id card": "id_document",
    "student id": "id_document", "student id card": "id_document", "student card": "id_document", "employee id": "id_document", "employee card": "id_document",
    "national id": "id_document", "voter id": "id_document", "driving license": "id_document", "transcript": "academic", "diploma": "academic",
    "certificate": "academic", "mark sheet": "academic", "marksheet": "academic", "textbook": "academic", "course book": "academic",
    "reference book": "academic", "syllabus": "academic", "lecture notes": "academic",
}

# Words that mean "no value" in a field.
PLACEHOLDERS = ["n/a", "na", "none", "null", "nil", "-", "unknown"]

# Recognisers of identity numbers (entity, pattern without its boundaries).
RECOGNISERS = [
    ("IN_AADHAAR", r"[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}"), ("IN_PAN", r"[A-Z]{5}[0-9]{4}[A-Z]"), ("IN_GSTIN", r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"),
    ("IN_PASSPORT", r"[A-PR-WY-Z][1-9][0-9]{6}[1-9]"), ("IN_VOTER_ID", r"[A-Z]{3}[0-9]{7}"), ("IN_DRIVING_LICENSE", r"[A-Z]{2}[- ]?[0-9]{2}[- ]?[0-9]{4}[- ]?[0-9]{7}"),
    ("IN_UPI", r"[a-zA-Z0-9._-]{2,256}@[a-zA-Z]{2,64}"), ("IN_IFSC", r"[A-Z]{4}0[A-Z0-9]{6}"),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+){0,8}[.][A-Za-z]{2,}"), ("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
]
# Score of a recogniser's hit, and words near it that raise the score.
SCORES = {
    "IN_AADHAAR": 0.85, "IN_PAN": 0.90, "IN_GSTIN": 0.92, "IN_PASSPORT": 0.85, "IN_VOTER_ID": 0.80, "IN_DRIVING_LICENSE": 0.85, "IN_UPI": 0.85, "IN_IFSC": 0.88, "EMAIL_ADDRESS": 1.0, "US_SSN": 0.85,
}
CONTEXT = {
    "IN_AADHAAR": ["aadhaar", "aadhar", "uid", "unique identification", "uidai"], "IN_PAN": ["pan", "permanent account number", "income tax"], "IN_GSTIN": ["gstin", "gst", "gstn", "goods and services tax"],
    "IN_PASSPORT": ["passport", "passport no", "passport number", "travel document"], "IN_VOTER_ID": ["voter id", "epic", "election card", "voter card"],
    "IN_DRIVING_LICENSE": ["driving license", "driver license", "dl no", "driving licence"], "IN_UPI": ["upi", "upi id", "upi payment", "vpa"], "IN_IFSC": ["ifsc", "ifsc code", "bank code", "neft", "rtgs"],
}
#: What a word nearby adds, within so many characters before a hit.
CONTEXT_GAIN, CONTEXT_REACH = 0.35, 40
# Labels and values of gender, and labels of medical and of laboratory numbers.
GENDER_LABELLED = r"(?i)(?:^|[^A-Za-z0-9_])(?:gender|sex)\s*[:-]?\s*(male|female|other|non-binary|transgender|[mf](?:[^A-Za-z0-9_]|$))"
GENDER_ALONE = r"(?i)\n[ \t]*(male|female)[ \t]*(?:\r?\n|$)"
RECORD_IDS = [
    r"(?i)(?:^|[^A-Za-z0-9_])(?:patient\s*id|medical\s*record\s*(?:#|number)?|mrn)\s*[:#-]?\s*(MRN-[0-9]{4,10})(?:[^A-Za-z0-9_]|$)",
    r"(?i)(?:^|[^A-Za-z0-9_])(?:patient\s*id|lab\s*id|laboratory\s*id)\s*[:#-]?\s*(LAB-[0-9]{4,10})(?:[^A-Za-z0-9_]|$)",
]
# Parts of the names of fields that hold personal data.
PERSONAL_FIELDS = [
    "email", "phone", "ssn", "social_security", "credit_card", "card_number", "name", "address", "patient_id", "medical_id", "dob", "date_of_birth", "student_id", "document_number",
]
# Fields, labels and words of textbooks, and what these must have.
BOOK_FIELDS = ["title", "book_title", "textbook_title", "author", "authors", "isbn", "isbn_10", "isbn_13", "publisher", "publication_year", "published_year"]
BOOK_LABELS = ["textbook", "book", "reference"]
BOOK_WORDS = ["textbook", "isbn", "publisher", "edition", "chapter"]
BOOK_REQUIRED = ["title", "author", "isbn", "publication_year"]
# Agents of the trace and their nodes in diagrams.
NODES = {"classifier": "classify", "extractor": "extract", "validator": "validate", "self_repair": "repair", "redactor": "redact", "reporter": "report"}
# Recognised entity to the type of personal data; NAME where an entity is not listed.
ENTITY_TYPES = {
    "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "US_SSN": "ssn", "CREDIT_CARD": "credit_card", "PERSON": "name", "LOCATION": "address", "DATE_TIME": "date_of_birth",
    "MEDICAL_LICENSE": "medical_id", "US_PASSPORT": "ssn", "US_DRIVER_LICENSE": "ssn", "US_BANK_NUMBER": "bank_account", "US_ITIN": "ssn", "UK_NHS": "medical_id", "IBAN_CODE": "bank_account",
    "IN_AADHAAR": "ssn", "IN_PAN": "tax_id", "IN_GSTIN": "tax_id", "IN_PASSPORT": "ssn", "IN_VOTER_ID": "ssn", "IN_DRIVING_LICENSE": "ssn", "IN_UPI": "credit_card", "IN_IFSC": "bank_account",
    "IP_ADDRESS": "name", "CRYPTO": "credit_card", "NRP": "name", "ES_NIF": "ssn", "ES_NIE": "ssn", "IT_DRIVER_LICENSE": "ssn", "IT_FISCAL_CODE": "ssn", "IT_VAT_CODE": "tax_id", "IT_IDENTITY_CARD": "ssn",
    "IT_PASSPORT": "ssn", "PL_PESEL": "ssn",
}
# Shortest texts that may be personal data of a type; 2 where a type is not listed.
MIN_LENGTHS = {"EMAIL": 6, "PHONE": 7, "SSN": 8, "US_SSN": 8, "CREDIT_CARD": 8, "BANK_ACCOUNT": 6, "US_BANK_NUMBER": 6, "NAME": 2, "ADDRESS": 8, "DATE_OF_BIRTH": 6, "DATE_TIME": 6, "MEDICAL_ID": 4, "MEDICAL_LICENSE": 4, "TAX_ID": 8}
NON_NAMES = ["invoice", "receipt", "total", "amount", "customer", "vendor", "authorization", "payment", "transaction", "billing", "service", "product", "order"]
STREET_WORDS = [
    "street", "st", "avenue", "ave", "road", "rd", "blvd", "boulevard", "drive", "dr", "lane", "ln", "court", "ct",
    "place", "pl", "nagar", "colony", "sector", "block", "apartment", "apt", "flat", "house", "layout", "phase", "main", "cross",
]
DUMMY_PHONES = ["1234567890", "0123456789", "9876543210", "0987654321"]

# Dates that fields are written in, in the order in which they are tried.
FIELD_DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d'T'H:m:s"]

# Thresholds of the reports, of the cache, and of vector search.
ACCURACY, RECALL, PRECISION = 0.90, 0.95, 0.90
CACHE_TTL_S, CACHE_CAP = 86_400, 5_000
EMBEDDING_DIM, NEIGHBOURS = 384, 3
