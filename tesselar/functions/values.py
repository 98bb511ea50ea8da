"""Word lists, patterns and defaults that results depend on."""

# Types of entities.
SEMANTIC_TYPES = ["RegulatoryConcept", "TechnicalConcept", "PoliticalConcept", "EconomicConcept", "Regulation", "Technology", "Organization", "Location", "Risk"]
METADATA_TYPES = ["Citation", "Author", "Journal", "Affiliation", "Document", "DocumentSection"]
CONCEPT_TYPES = ["RegulatoryConcept", "TechnicalConcept", "PoliticalConcept", "EconomicConcept"]
ACADEMIC_TYPES = ["Citation", "Author", "Journal", "Affiliation"]
SKIPPED_TYPES = ["Document", "DocumentSection"]

# Names that are no entities, by case and by type.
GARBAGE = [r"^\.+$", "^\u2026$", r"^\d+%$", r"^[a-z]$", r"^[RP]\d+$", r"^n_[a-z]$", r"^[A-Z][a-z]?$", r"^[a-z]+[A-Z]", r"^[A-Z]\.$", r"^Eq\.$", r"^d\*$", r"^[a-z]{2}$", r"^[_a-z]\d$", r"^[A-Z]\d$"]
GARBAGE_ANY_CASE = [r"^N/?A$", r"^RQ\d*$", r"^(who|why|how|what|when|use)$", r"^(res|age|fee|unl|tax)$", r"^(law|sex|act|noa)$", r"^ext$"]
GARBAGE_NUMBERS = [r"^\d{1,3}$", r"^\[\d+\]$"]
GARBAGE_DOCUMENTS = [
    r"^\.+$", "^\u2026$", r"^Table\s*\d+$", r"^Figure\s*\d+$", r"^Fig\.\s*\d+$", r"^Algorithm\s*\d+$", r"^ChatGPT\d*$", r"^GPT-?\d*$", r"^CNN$", r"^LSTM$", r"^XGBoost$", r"^RF$", r"^DRM$", r"^Chatbot$",
    r"^(2018|2019|2020|2021|2022|2023|2024|2025)$", r"^Article$", r"^AI$", r"^(this|This)\s+(paper|study)$", r"^education$", r"^healthcare$", r"^China$", r"^European Union$", r"^Narrative\s*\d+$", r"^Contribution\s*\d+$",
    r"^Contributions\s*\d+$", r"^\d{1,2}$", r"^.{1,3}$",
]
GARBAGE_DOCUMENTS_ANY_CASE = [
    r"^systems?$", r"^graph$", r"^rights?$", r"^learning$", r"^models?$", r"^data$", r"^governments?$", r"^regulations?$", r"^education$", r"^research$", r"^safety$", r"^frameworks?$", r"^services?$", r"^study$",
    r"^health$", r"^content$", r"^ethics$", r"^tools$", r"^papers?$", r"^students?$", r"^impact$", r"^article$", r"^governance$", r"^training$", r"^testing$", r"^industry$", r"^transport$", r"^records?$",
]
GARBAGE_SECTIONS = [r"^\.+$", "^\u2026$", r"^Article\.+$", r"^Table\s*\d+$", r"^Figure\s*\d+$", r"^Fig\.\s*\d+$", r"^Abstract$", r"^ABSTRACT$", r"^Keywords$", r"^KEYWORDS$", r"^Article$", r"^Article\s*\(not specified\)$", r"^Section$", r"^\d{1,2}$", r"^.{1,3}$"]

# Headings of sections without content, and of bibliographies.
DROPPED_SECTIONS = [
    "ARTICLEINFO", "ARTICLE INFO", "KEYWORDS", "Keywords", "Keywords:", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "Acknowledgments", "Acknowledgements", "Acknowledgment", "ACKNOWLEDGEMENT", "Author contributions",
    "Author Contributions", "Credit authorship contribution statement", "Author biographies", "Funding", "Funding information", "Information for funding/support or the lack of it", "Conflict of interest",
    "Conflicts of interest", "CONFLICT OF INTEREST", "CONFLICT OF INTEREST STATEMENT", "Declaration of competing interest", "Declaration of conflicting interests", "Declarations", "Declaration", "DECLARATION OF INTERESTS",
    "Competing interests", "Disclosure statement", "Data availability", "Data Availability", "DATA AVAILABILITY STATEMENT", "Availability of data and materials", "ORCID", "ORCID iDs", "ORCID:", "Correspondence",
    "Corresponding author", "Corresponding author:", "Open Access", "OPEN ACCESS", "Publisher's note", "Check for updates", "Additional information", "CCS CONCEPTS", "Ethics statement", "Abbreviations", "Notes",
]
REFERENCE_SECTIONS = ["References", "REFERENCES", "Bibliography", "BIBLIOGRAPHY", "Works Cited", "ACM Reference Format:"]
GARBAGE_HEADERS = [
    "ARTICLEINFO", "ARTICLE INFO", "KEYWORDS", "ORCID", "OPEN ACCESS", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "Acknowledgments", "Acknowledgements", "Funding", "Author contributions", "Correspondence", "Data availability",
    "Data availability statement", "Conflict of interest", "Competing interests", "Declaration of competing interest", "Declarations", "Disclosure statement", "Publisher's note", "Publisher's Note", "CCS CONCEPTS", "References",
    "REFERENCES", "Bibliography",
]
HEADERS = {
    "regulation": [r"^#{1,6}\s+.+$", r"^Article\s+\d+", r"^Section\s+\d+", r"^\d+\.\s+[A-Z]", r"^[A-Z][A-Z\s]{3,}$"],
    "paper": [r"^#\s+\d+(?:\.\d+)*\.?\s+.+$", r"^#\s+(?:Introduction|Conclusion|Discussion|Results|Methods|Methodology|Background|Literature|Related\s+Work|Theoretical|Empirical|Analysis|Findings|Implications|Limitations|Future).*$"],
}

# LaTeX notation and what becomes of it, in this order.
LATEX = [
    (r"\$([^$]+)\$", "$1"), (r"\^\{([^}]+)\}", "$1"), (r"\^(\d+)", ""), (r"_\{([^}]+)\}", "$1"), (r"\\text(?:bf|it|rm|sf|tt)\{([^}]+)\}", "$1"), (r"\\emph\{([^}]+)\}", "$1"), (r"\\cite\{[^}]+\}", ""), (r"\\ref\{[^}]+\}", ""),
    (r"\\label\{[^}]+\}", ""), (r"\\(?:section|subsection|subsubsection)\*?\{([^}]+)\}", "$1"), (r"\\[a-zA-Z]+(?:\{[^}]*\})?", ""),
]

# Words in a query that name a jurisdiction or a kind of document. The names of laws stand with the
# code of the jurisdiction that they are laws of, as the lookup is by code.
JURISDICTION_WORDS = {
    "EU": "EU|European Union|Europe|GDPR|AI Act|EU AI Act|DSA|Digital Services Act|DMA|Digital Markets Act", "AT": "Austria|Austrian", "BE": "Belgium|Belgian", "CZ": "Czech Republic|Czech|Czechia", "DK": "Denmark|Danish",
    "FI": "Finland|Finnish", "FR": "France|French", "DE": "Germany|German", "HU": "Hungary|Hungarian", "IE": "Ireland|Irish", "IT": "Italy|Italian", "LU": "Luxembourg", "NL": "Netherlands|Dutch|Holland", "NO": "Norway|Norwegian",
    "PL": "Poland|Polish", "PT": "Portugal|Portuguese", "RO": "Romania|Romanian", "ES": "Spain|Spanish", "SE": "Sweden|Swedish", "CH": "Switzerland|Swiss", "GB": "UK|United Kingdom|Britain|British",
    "US": "US|USA|United States|America|American|CCPA|HIPAA", "AR": "Argentina|Argentine", "BR": "Brazil|Brazilian", "CA": "Canada|Canadian", "CL": "Chile|Chilean", "CO": "Colombia|Colombian", "MX": "Mexico|Mexican", "PE": "Peru|Peruvian",
    "AU": "Australia|Australian", "CN": "China|Chinese|PRC", "HK": "Hong Kong|HK", "IN": "India|Indian", "ID": "Indonesia|Indonesian", "IL": "Israel|Israeli", "JP": "Japan|Japanese", "MY": "Malaysia|Malaysian",
    "NZ": "New Zealand|NZ|Kiwi", "PK": "Pakistan|Pakistani", "PH": "Philippines|Filipino", "SG": "Singapore|Singaporean", "KR": "South Korea|Korea|Korean", "TW": "Taiwan|Taiwanese", "EG": "Egypt|Egyptian", "KE": "Kenya|Kenyan",
    "NG": "Nigeria|Nigerian", "SA": "Saudi Arabia|Saudi", "ZA": "South Africa|South African", "AE": "UAE|United Arab Emirates|Dubai|Emirati",
}
DOCUMENT_WORDS = {
    "regulation": "regulations?|regulatory|laws?|legal|legislation|acts?|directives?|statutes?|ordinances?|rules?|requirements?|compliance|mandatory|jurisdiction|government|official",
    "academic": "papers?|articles?|publications?|stud(?:y|ies)|research|researchers?|journals?|proceedings?|conference|authors?|scholars?|academics?|literature",
}

# Names of jurisdictions as typed and their codes, in this order.
JURISDICTION_ALIASES = {
    "European Union": "EU",
    "United States": "US",
    "United Kingdom": "GB",
    "United Arab Emirates": "AE",
    "South Korea": "KR",
    "South Africa": "ZA",
    "New Zealand": "NZ",
    "Hong Kong": "HK",
    "Saudi Arabia": "SA",
    "Czech Republic": "CZ",
    "UK": "GB",
    "USA": "US",
    "America": "US",
    "UAE": "AE",
    "Korea": "KR",
    "Germany": "DE",
    "France": "FR",
    "Spain": "ES",
    "Italy": "IT",
    "China": "CN",
    "Japan": "JP",
    "Brazil": "BR",
    "India": "IN",
    "Australia": "AU",
    "Canada": "CA",
    "Mexico": "MX",
    "Argentina": "AR",
    "Netherlands": "NL",
    "Belgium": "BE",
    "Switzerland": "CH",
    "Sweden": "SE",
    "Norway": "NO",
    "Denmark": "DK",
    "Finland": "FI",
    "Poland": "PL",
    "Austria": "AT",
    "Portugal": "PT",
    "Ireland": "IE",
    "Greece": "GR",
    "Hungary": "HU",
    "Romania": "RO",
    "Israel": "IL",
    "Egypt": "EG",
    "Nigeria": "NG",
    "Kenya": "KE",
    "Singapore": "SG",
    "Malaysia": "MY",
    "Indonesia": "ID",
    "Philippines": "PH",
    "Taiwan": "TW",
    "Pakistan": "PK",
    "Chile": "CL",
    "Colombia": "CO",
    "Peru": "PE",
    "Luxembourg": "LU",
}

# Frequent words by which a language is told.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "which", "is", "for", "by", "with", "on"],
    "fr": ["le", "la", "les", "des", "du", "et", "une", "dans", "pour", "est", "que", "sur"],
    "de": ["der", "die", "das", "und", "den", "von", "mit", "für", "ein", "eine", "nicht", "auf"],
    "es": ["el", "los", "las", "del", "una", "por", "para", "que", "con", "su", "se", "y"],
}
