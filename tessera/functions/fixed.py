"""Word lists, labels, patterns and constants that results depend on."""

# --- fixed values: record vocabulary ------------------------------------------------------------------------------
BILINGUAL = ["title", "agency", "category", "description", "eligibility", "requirements", "required_documents", "steps", "fees", "processing_time", "target_audience", "service_languages", "notes", "official_url", "source_last_modified"]
PLAIN = ["service_id", "source_type", "source_domain", "verification_status", "date_collected", "last_verified", "contact_information", "service_channel", "source_record_id", "source_sha256", "provenance_notes"]
SOURCE_TYPES = ["official_web_page", "official_open_data", "manual_saved_page", "seed_manual_summary"]
STATUSES = ["verified_official_capture", "unverified"]
INDEXABLE = ["verified_official_capture"]
OFFICIAL_SUFFIXES = [".gov.sa", ".edu.sa"]
OFFICIAL_DOMAINS = ["my.gov.sa", "absher.sa"]

# --- fixed values: sections of a record and their labels ----------------------------------------------------------
SECTIONS = [("overview", ["description"]), ("requirements", ["eligibility", "requirements"]), ("documents", ["required_documents"]), ("steps", ["steps"]), ("service_facts", ["fees", "processing_time", "target_audience", "service_languages"]), ("notes", ["notes"])]
LABELS = {
    "en": {"title": "Service", "notes": "Important notes", "overview": "Overview", "requirements": "Conditions", "documents": "Required documents", "steps": "Steps", "service_facts": "Fees & service details", "description": "Description", "eligibility": "Eligibility", "required_documents": "Required documents", "fees": "Fees", "processing_time": "Processing time", "target_audience": "Beneficiaries", "service_languages": "Service languages"},
    "ar": {"title": "الخدمة", "notes": "ملاحظات مهمة", "overview": "نظرة عامة", "requirements": "الشروط", "documents": "المستندات المطلوبة", "steps": "الخطوات", "service_facts": "الرسوم وتفاصيل الخدمة", "description": "الوصف", "eligibility": "الأهلية", "required_documents": "المستندات المطلوبة", "fees": "الرسوم", "processing_time": "مدة التنفيذ", "target_audience": "الفئة المستفيدة", "service_languages": "لغة الخدمة"},
}

# --- fixed values: tokens -----------------------------------------------------------------------------------------
STOP_EN = ["the", "a", "an", "of", "to", "for", "in", "on", "and", "or", "is", "are", "be", "my", "i", "me", "do", "does", "how", "can", "what", "where", "who", "which", "with", "by", "at", "it", "this", "that", "from", "as", "your", "you", "want", "need", "get", "please", "about", "should", "would", "will", "am", "if", "there", "any", "we"]
STOP_AR = ["كيف", "ما", "ماذا", "هل", "من", "في", "على", "الى", "عن", "او", "ان", "انا", "ابغي", "ابي", "ودي", "وش", "ايش", "هذا", "هذه", "التي", "الذي", "مع", "لي", "كم", "متي", "اين", "وين"]
SUFFIXES_EN = ["ing", "ed", "es", "s"]
PREFIX_AR = "^(?:وال|فال|بال|كال|لل|ال|و|ف|ب|ل|ك)(?=[ء-ي]{3,})"
SUFFIX_AR = "(?:ات|ين|ون|ها|هم|ه)$"
SUFFIX_AR_STATIC = "(?:ات|ين|ون|ها|هم|ه|ي)$"

# --- fixed values: retrieval --------------------------------------------------------------------------------------
BM25 = {"k1": 1.2, "b": 0.75, "squash": 6.0}
V2_DEFAULT = {"w_dense": 0.4, "w_char": 0.3, "w_bm25": 0.3, "w_tcov": 0.0, "expand": True}
CONFIGS = {
    "v1": {"method": "hybrid", "alpha": 0.4, "t_answer": 0.4236, "t_tentative": 0.4236, "t_related": None},
    "v2": {"method": "v2", "w_dense": 0.3, "w_char": 0.3, "w_bm25": 0.0, "w_tcov": 0.1, "expand": True, "t_answer": 0.3906, "t_tentative": 0.2852, "t_related": 0.1999},
    "v3": {"method": "v2", "w_dense": 0.45, "w_char": 0.15, "w_bm25": 0.15, "w_tcov": 0.1, "expand": True, "t_answer": 0.4388, "t_tentative": 0.3091, "t_related": 0.2599},
}
ACTION_BONUS, ACTION_PENALTY, VARIANT_DISCOUNT = 0.02, 0.03, 0.03
SUPPORT_MARGIN, MAX_SUPPORT = 0.06, 2
V1_RELATED_MARGIN, V1_STRONG_MARGIN, V1_MAX_RELATED = 0.05, 0.10, 2

# --- fixed values: official terms appended to a question (patterns -> terms) -----------------------------------------
EXPAND_EN = [
    (["business name", "company name", "shop name", "store name", "brand name for my business", "commercial name"], "trade name"),
    (["book", "booking", "hold", "secure"], "reserve reservation"),
    (["cr", "c.r", "commercial register", "business registration", "business license", "trade license"], "commercial registration"),
    (["llc", "l.l.c"], "limited liability company"),
    (["jsc"], "joint stock company"),
    (["sole trader", "one person business", "one-person business", "own business", "sole proprietor"], "sole proprietorship establishment"),
    (["open a company", "start a company", "set up a company", "form a company", "incorporate"], "establish company incorporation"),
    (["shut down", "close my business", "close my shop", "closing my business"], "cancel deletion write off"),
    (["renew", "renewal", "extend", "extension"], "renewal extension"),
    (["refund", "money back", "scam", "cheated", "bad product"], "complaint consumer"),
    (["tax number", "vat number", "tin"], "tax registration number"),
    (["vat"], "value added tax"),
    (["zakat"], "zakat"),
    (["import", "importing", "ship goods into"], "import customs"),
    (["export", "exporting"], "export customs"),
    (["job", "jobs", "worker", "workers", "employee", "employees", "staff", "maid", "housemaid", "driver"], "labor employment"),
    (["work visa", "recruit", "recruitment", "hire from abroad"], "visa recruitment labor"),
    (["iqama", "residence permit", "residency", "resident id", "resident identity"], "residence iqama resident identity"),
    (["driving licence", "driving license", "driver license", "driver's license", "drivers license", "driving permit"], "driving license"),
    (["traffic fine", "traffic fines", "traffic ticket", "traffic violation", "traffic violations", "speeding ticket", "saher"], "traffic violations"),
    (["istimara", "istemarah", "vehicle registration", "car registration"], "vehicle registration"),
    (["exit re-entry", "exit reentry", "re-entry visa", "reentry visa", "re entry visa"], "exit re-entry visa"),
    (["final exit"], "final exit visa"),
    (["passport"], "passport"),
    (["transfer sponsorship", "change sponsor", "sponsor transfer", "kafala"], "transfer services employer"),
    (["wage", "salary", "salaries", "unpaid salary"], "wage protection"),
    (["disabled", "disability", "special needs"], "persons with disabilities"),
    (["building permit", "construction permit", "build a house"], "building permit"),
    (["shop license", "store license", "municipal license", "balady", "baladi"], "commercial activity license municipal"),
    (["pilgrim", "pilgrimage"], "hajj umrah"),
    (["rawdah", "rawda", "prophet's mosque"], "al rawdah al sharifah"),
    (["power of attorney", "poa"], "power of attorney"),
    (["divorce", "marriage", "custody", "alimony", "inheritance"], "family personal status"),
    (["school transfer", "move school", "change school"], "transferring student school"),
    (["certificate equivalency", "degree recognition", "recognize my degree", "recognise my degree"], "equivalency certificates"),
    (["medicine", "drug", "drugs", "cosmetics", "cosmetic", "medical device"], "food drug registration"),
    (["how much", "cost", "price", "charge", "charges"], "fees"),
    (["how long", "processing time", "time does it take", "duration"], "duration of service"),
    (["papers", "paperwork", "what do i need to bring"], "required documents"),
    (["who can apply", "eligible", "eligibility", "qualify"], "conditions eligibility"),
]
EXPAND_AR = [
    (["اسم محل", "اسم المحل", "اسم محلي", "اسم لمحلي", "اسم لمحل", "اسم شركه", "اسم الشركه", "اسم شركتي", "اسم لشركتي", "اسم مءسستي", "اسم لمءسستي", "اسم لمشروعي", "اسم مشروع", "اسم نشاط", "اسم تجاري"], "اسم تجاري"),
    (["احجز", "حجز", "اسجل اسم"], "حجز"),
    (["سجل", "السجل"], "السجل التجاري"),
    (["ذات مسءوليه محدوده", "llc"], "شركه ذات مسءوليه محدوده"),
    (["مءسسه فرديه", "مءسستي"], "مءسسه فرديه"),
    (["اطلع", "استخرج", "اسوي", "اسوي لي"], "اصدار"),
    (["اقفل", "اسكر", "اغلق", "الغي"], "شطب الغاء"),
    (["اجدد", "تجديد", "امدد", "تمديد"], "تجديد تمديد"),
    (["فلوسي", "استرجاع", "نصب", "احتيال", "غش"], "شكوي"),
    (["ضريبه القيمه المضافه", "الضريبه", "الفاتوره"], "ضريبه القيمه المضافه"),
    (["عامل", "عماله", "خادمه", "سايق", "موظف", "موظفين"], "العمل العماله"),
    (["اقامه", "الاقامه", "هويه مقيم"], "الاقامه هويه مقيم"),
    (["رخصة القيادة", "رخصة قيادة", "رخصة السواقة", "ليسن"], "رخصة القيادة"),
    (["مخالفة مرورية", "مخالفات مرورية", "المخالفات المرورية", "مخالفات المرور", "ساهر", "مخالفاتي"], "المخالفات المرورية"),
    (["استمارة", "الاستمارة", "رخصة سير", "رخصة السير"], "رخصة سير"),
    (["خروج وعودة", "خروج و عودة"], "تأشيرة خروج وعودة"),
    (["خروج نهائي"], "تأشيرة الخروج النهائي"),
    (["فقدت", "ضاع", "ضاعت", "ضايع", "مفقود"], "بدل مفقود فقدان"),
    (["جواز", "الجواز"], "جواز السفر"),
    (["نقل كفاله", "نقل الكفاله", "نقل خدمات"], "نقل خدمات"),
    (["راتب", "رواتب", "الراتب"], "حمايه الاجور"),
    (["رخصه بلدي", "بلدي", "رخصه المحل", "رخصه محل"], "رخصه نشاط تجاري بلديه"),
    (["رخصه بناء", "تصريح بناء", "ابني"], "رخصه بناء"),
    (["الحج", "حج", "العمره", "عمره", "معتمر", "حاج"], "الحج العمره"),
    (["الروضه"], "الروضه الشريفه"),
    (["وكاله", "توكيل"], "وكاله"),
    (["طلاق", "زواج", "حضانه", "نفقه", "ورث", "ميراث", "المواريث"], "احوال شخصيه"),
    (["نقل طالب", "انقل ولدي", "انقل بنتي", "مدرسه ثانيه"], "نقل طالب مدرسه"),
    (["معادله", "اعادل", "معادله شهاده"], "معادله الشهادات"),
    (["دواء", "ادويه", "مستحضرات تجميل", "جهاز طبي"], "تسجيل الغذاء والدواء"),
    (["كم رسوم", "كم سعر", "بكم", "التكلفه", "كم تكلف"], "رسوم الخدمه"),
    (["كم ياخذ", "كم مده", "متي يطلع", "مده"], "مده تنفيذ الخدمه"),
    (["وش احتاج", "ايش احتاج", "الاوراق", "اوراق"], "المستندات المطلوبه"),
    (["مين يقدر", "من يحق", "الشروط"], "الشروط"),
]

# --- fixed values: intents, in order of precedence, on matching-normalised text ----------------------------------------
INTENTS = [
    ("fees", r"\b(fee|fees|cost|costs|price|how much|charge|pay|payment)\b|رسوم|تكلف|كم سعر|بكم|قيمه|مبلغ|سداد|ادفع"),
    ("time", r"\b(how long|duration|processing time|days|time does|when will)\b|مده|كم ياخذ|متي|كم يوم|ايام"),
    ("documents", r"\b(documents?|papers?|paperwork|bring|attach|required docs?)\b|مستند|اوراق|وثاءق|مرفقات|وش احتاج|ايش احتاج"),
    ("requirements", r"\b(eligib\w*|requirements?|conditions?|who can|qualif\w*|allowed)\b|شروط|اشتراطات|يحق|مين يقدر|الاهليه|متطلبات"),
    ("steps", r"\b(how (do|can|to)|steps?|procedure|process|apply|register|where can)\b|كيف|خطوات|طريقه|اجراءات|اقدم|اسجل"),
]
INTENT_SECTION = {"documents": "docs", "requirements": "need", "steps": "steps", "fees": "fees", "time": "fees"}

# --- fixed values: actions, on matching-normalised text padded with spaces ----------------------------------------------
ACTIONS_STRONG = [
    ("issue", r"\b(issu(e|es|ing|ance)|establish(ing|ed)?|incorporat\w*|creat(e|ing|ion)|set ?up|start(ing)? a)\b|اصدار|اصدر|استخراج|استخرج|اطلع |اطلع$|طلع |تاسيس|اسس |انشاء|انشي"),
    ("reserve", r"\b(reserv\w*|book(ing)?)\b|حجز|احجز"),
    ("renew", r"\b(renew\w*|extend\w*|extension)\b|تجديد|اجدد|جدد|تمديد|امدد"),
    ("cancel", r"\b(cancel\w*|delet\w*|remov\w*|clos(e|ing|ure)|write[- ]?off|strike[- ]?off|terminat\w*|deregist\w*|shut ?down)\b|الغاء|الغي|شطب|اشطب|حذف|احذف|اغلاق|اقفل|اقفال|ايقاف|اوقف"),
    ("modify", r"\b(modif\w*|updat\w*|amend\w*|chang(e|es|ing)|edit\w*|correct\w*)\b|تعديل|اعدل|عدل |تحديث|احدث|تغيير|اغير|تصحيح"),
    ("transfer", r"\b(transfer\w*|assign\w*)\b|نقل|انقل|تنازل|التنازل"),
    ("inquire", r"\b(inquir\w*|enquir\w*|quer(y|ies)|check(ing)?|verif\w*|view(ing)?|track\w*|status)\b|استعلام|استعلم|التحقق|تحقق|اتحقق|استعراض|الاطلاع|اطلاع|متابعه|اتابع"),
    ("replace", r"\b(replac\w*|lost|los(e|ing)|damaged|stolen|reissu\w*)\b|بدل|فاقد|تالف|فقدت|فقد |ضاع|ضايع|ضاعت"),
    ("unlock", r"\b(unlock\w*|lift\w*|reactivat\w*|unsuspend\w*)\b|رفع تعليق|رفع ايقاف|فك"),
    ("object", r"\b(object(ion)?|appeal\w*|complain\w*|dispute)\b|اعتراض|الاعتراض|اعترض|تظلم"),
    ("extract", r"\b(extract\w*|certificate|print\w*)\b|مستخرج|شهاده|طباعه|اطبع"),
    ("add", r"\b(add(ing)?)\b|اضافه|اضيف"),
]
ACTIONS_WEAK = [
    ("issue", r"\b(regist(er|ering|ration)|get(ting)?|obtain\w*|apply(ing)?|application|new|open(ing)?)\b|تسجيل|التسجيل|اسجل|قيد|الحصول|احصل|تقديم|اقدم|جديد|افتح|فتح"),
    ("pay", r"\b(pay(ing|ment)?|settle\w*)\b|سداد|اسدد|دفع|ادفع"),
]

# --- fixed values: redaction, in this order --------------------------------------------------------------------------
REDACTIONS = [
    ("[IBAN]", r"(?i)\bSA\d{2}(?:[ ]?[0-9A-Z]{4}){5}\b"),
    ("[CARD_NUMBER]", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    ("[ID_NUMBER]", r"(?<!\d)[12]\d{9}(?!\d)"),
    ("[OTP]", r"(?i)(?:otp|one[- ]time|verification code|code|رمز(?: التحقق)?|كود)[^\p{L}\p{N}_]{0,3}\d{4,8}\b"),
    ("[PASSPORT_NUMBER]", r"(?i)(?:passport|جواز)(?:\s*(?:no\.?|number|رقم))?[^\p{L}\p{N}_]{0,3}[A-Z]{1,2}\d{6,8}\b"),
]

# --- fixed values: claims ----------------------------------------------------------------------------------------------
URL_IN_TEXT = r"(?i)https?://|www\.|\b[\w-]+\.(?:gov|com|org|net|sa)\b"
NUMBER = r"\d+(?:[.,]\d+)*"
LIST_NUMBER = r"(?i)^\s*(?:step\s*)?\d{1,2}\s*[.)\-:]\s+"
EVIDENCE_ID = r"S(\d+)(?:\s*[.:_\-/]\s*([A-Za-z_]+))?"
FIELD_ALIASES = {"documents": "required_documents", "docs": "required_documents", "fee": "fees", "processing": "processing_time", "time": "processing_time", "requirement": "requirements", "overview": "description", "step": "steps", "channel": "service_channel", "audience": "target_audience"}
EVIDENCE_FIELDS = ["description", "eligibility", "requirements", "required_documents", "steps", "fees", "processing_time", "target_audience", "notes"]
CLAIM_SECTIONS = ["overview", "eligibility", "requirements", "documents", "steps", "fees", "processing", "where_to_apply", "notes"]

# --- fixed values: texts of answers --------------------------------------------------------------------------------------
UI = {
    "en": {"lead": "The official service that matches your question is “{title}” ({agency}).", "lead_tentative": "I'm not certain this is exactly what you mean. The closest official service in the verified sources is “{title}” ({agency}) — please check it against your situation.", "lang_note": "Official text for [{n}] is only published in {lang}; it is shown as published, without machine translation.", "conflict": "Sources state different values for Fees; each is shown with its source. Check which one applies to you.", "sec_direct": "Direct answer", "sec_need": "What you need", "sec_docs": "Documents", "sec_steps": "Steps", "sec_fees": "Fees & processing", "sec_who": "Who it is for", "sec_notes": "Important notes", "fees": "Fees", "time": "Processing time", "langs": "Service languages", "contact": "Contact", "name_en": "English", "name_ar": "Arabic"},
    "ar": {"lead": "الخدمة الرسمية المطابقة لسؤالك هي «{title}» ({agency}).", "lead_tentative": "لست متأكداً أن هذا ما تقصده تماماً. أقرب خدمة رسمية في المصادر هي «{title}» ({agency}) — يرجى التحقق من مناسبتها لحالتك.", "lang_note": "النص الرسمي للمصدر [{n}] منشور باللغة {lang} فقط، ويُعرض كما نُشر دون ترجمة آلية.", "conflict": "تذكر المصادر قيماً مختلفة لـالرسوم؛ تُعرض كل قيمة مع مصدرها. تحقّق أيها ينطبق عليك.", "sec_direct": "الإجابة المباشرة", "sec_need": "ما تحتاجه", "sec_docs": "المستندات", "sec_steps": "الخطوات", "sec_fees": "الرسوم والمدة", "sec_who": "الفئة المستفيدة", "sec_notes": "ملاحظات مهمة", "fees": "الرسوم", "time": "مدة التنفيذ", "langs": "لغة الخدمة", "contact": "التواصل", "name_en": "الإنجليزية", "name_ar": "العربية"},
}
REFERENTIAL = r"(?i)\b(it|this|that|these|those|the service|same|there)\b|هذه|هذا|ذلك|تلك|نفس|الخدمه|لها|له|فيها|عليها"
FOLLOWUP_WORDS = 9

# --- fixed values: the field that answers an intent, how notes call it, and the note where no evidence backs it ---------------
INTENT_FIELDS = {
    "fees": ("fees", "the current fee", "الرسوم الحالية"),
    "documents": ("required_documents", "the required documents", "المستندات المطلوبة"),
    "time": ("processing_time", "the processing time", "مدة التنفيذ"),
    "requirements": ("requirements", "the eligibility requirements", "الشروط والمتطلبات"),
}
NOT_VERIFIED = {"en": "Not verified from the available official evidence: ", "ar": "لم يتم التحقق من المصادر الرسمية المتاحة: "}
