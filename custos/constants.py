"""Fixed names the data model relies on."""

# Column and view names that must match the clinical schema.
SUBJECT_ID = "patientId"
CLAUSES = "clauses"
DATE = "date"
VALUE = "value"
SOCIAL_ID = "socialId"
BIRTH_DATE = "birthDate"
BLOOD_TESTS = "blood_tests"
PROFILES = "patientsProfiles"
