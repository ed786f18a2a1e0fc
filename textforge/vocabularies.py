"""Vocabularies of the nine markets.

All lists of this module are fixed values: words, phrases, places and weights that decide results, as plain text.
Texts are normalised before they are compared (functions.text.normalise), and so are the words where a rule says so.
"""

# Places: allowed, blocked and foreign ones.

BE_PLACES = (
    "Brussels", "Bruxelles", "Belgium", "Belgique", "Flanders", "Vlaanderen", "Flemish", "Wallonia", "Wallonie", "Flemish Brabant", "Brabant Flamand",
    "Brabant Wallon", "Walloon Brabant", "Hainaut", "Liege", "Liege Province", "Charleroi", "Namur", "Mons", "Louvain-la-Neuve", "Leuven", "Louvain",
    "Antwerp", "Anvers", "Ghent", "Gent", "East Flanders", "West Flanders", "Mechelen", "Malines", "Kortrijk", "Limbourg", "Limburg", "Arlon",
    "Luxembourg", "Remote", "Teletravail", "Telework",
)

CH_PLACES = (
    "Switzerland", "Suisse", "Schweiz", "Svizzera", "Geneva", "Geneve", "Vaud", "Lausanne", "Neuchatel", "Jura", "Fribourg", "Freiburg", "Valais",
    "Wallis", "Sion", "Nyon", "Montreux", "Yverdon", "Biel", "Bienne", "Bern", "Berne", "Basel", "Bale", "Zurich", "Luzern", "Lucerne", "Zug",
    "Winterthur", "Lugano", "Remote", "Teletravail", "Telework", "Work from home",
)

CH_ROMANDIE_PLACES = (
    "Switzerland", "Suisse", "Schweiz", "Geneva", "Geneve", "Genf", "Vaud", "Waadt", "Lausanne", "Neuchatel", "Neuenburg", "Jura", "Jura bernois",
    "Berner Jura", "Fribourg", "Freiburg", "Valais", "Wallis", "Sion", "Nyon", "Montreux", "Yverdon", "Bienne", "Le Mont-sur-Lausanne", "Morges",
    "Gland", "Renens", "Prilly", "Ecublens", "Écublens", "Chavannes-pres-Renens", "Chavannes-près-Renens", "Preverenges", "Préverenges", "Carouge",
    "Lancy", "Versoix", "Meyrin", "Aclens", "Ouest Lausannois", "Riviera-Pays-d'Enhaut", "Saane", "Gros-de-Vaud", "Lavaux-Oron", "Broye-Vully",
    "Glane", "Veveyse", "Jura-Nord vaudois", "Aigle", "Villars-sur-Glane", "Villars-sur-Glâne", "Granges-Paccot", "Franches-Montagnes", "Delemont",
    "Delémont", "Martigny", "Monthey", "Conthey", "Herens", "Remote", "Teletravail", "Telework", "Work from home",
)

CH_BLOCKED_PLACES = (
    "zurich", "zuerich", "zug", "bern", "berne", "basel", "bale", "luzern", "lucerne", "winterthur", "st. gallen", "sankt gallen",
)

CH_FOREIGN_PLACES = (
    "germany", "deutschland", "france", "belgium", "belgique", "netherlands", "nederland", "austria", "osterreich", "italy", "italia", "spain",
    "portugal", "poland", "romania", "bulgaria", "united kingdom", "uk", "england", "usa", "united states", "canada",
)

MA_PLACES = (
    "Morocco", "Maroc", "Casablanca", "Casablanca-Mohammedia", "Rabat", "Rabat-Sale-Kenitra", "Rabat-Salé-Kénitra", "Marrakech", "Marrakech-Safi",
    "Agadir", "Souss-Massa", "Tanger", "Tangier", "Tanger-Tetouan-Al Hoceima", "Tanger-Tétouan-Al Hoceïma", "Tetouan", "Tétouan", "Kenitra",
    "Kénitra", "Fes", "Fès", "Fès-Meknès", "Meknes", "Meknès", "Oujda", "Oriental", "El Jadida", "Settat", "Mohammedia", "Bouskoura", "Benguerir",
    "Temara", "Témara", "Salé", "Nador", "Remote", "Teletravail", "Télétravail", "Hybrid",
)

NL_PLACES = (
    "Netherlands", "Nederland", "Amsterdam", "Rotterdam", "The Hague", "Den Haag", "Utrecht", "Eindhoven", "Tilburg", "Groningen", "Almere", "Breda",
    "Nijmegen", "Enschede", "Apeldoorn", "Haarlem", "Leiden", "Delft", "Maastricht", "Arnhem", "Remote", "Hybrid", "Work from home",
)

DE_PLACES = (
    "Germany", "Deutschland", "Berlin", "Munich", "München", "Frankfurt", "Hamburg", "Cologne", "Köln", "Stuttgart", "Düsseldorf", "Dusseldorf",
    "Leipzig", "Dortmund", "Nuremberg", "Nürnberg", "Hannover", "Bremen", "Dresden", "Bonn", "Mannheim", "Karlsruhe", "Freiburg", "Remote", "Hybrid",
    "Work from home", "Home office",
)

DE_BLOCKED_PLACES = (
    "Cluj", "Bucharest", "Warsaw", "Krakow", "Kraków", "Wroclaw", "Wrocław", "Timisoara", "Iași", "Poznań", "Poznan", "Gdansk", "Gdańsk", "Katowice",
    "Lodz", "Łódź", "Sofia", "Bratislava", "Prague", "Budapest", "Kyiv", "Kiev", "Belgrade", "Sarajevo",
)

FR_PLACES = (
    "France", "Paris", "Lyon", "Bordeaux", "Toulouse", "Marseille", "Nantes", "Strasbourg", "Montpellier", "Lille", "Grenoble", "Nice", "Rennes",
    "Sophia-Antipolis", "Sophia Antipolis", "Île-de-France", "Ile-de-France", "La Défense", "La Defense", "Massy", "Vélizy", "Velizy", "Meudon",
    "Puteaux", "Neuilly", "Levallois", "Courbevoie", "Boulogne", "Issy", "Clichy", "Aix-en-Provence", "Aix en Provence", "Sophia", "Remote",
    "Teletravail", "Télétravail", "Hybrid", "Hybride",
)

GB_PLACES = (
    "United Kingdom", "UK", "England", "London", "Manchester", "Edinburgh", "Birmingham", "Bristol", "Leeds", "Cambridge", "Oxford", "Sheffield",
    "Liverpool", "Newcastle", "Nottingham", "Reading", "Guildford", "Slough", "Staines", "Coventry", "Glasgow", "Cardiff", "Belfast", "Remote",
    "Hybrid", "Work from home",
)

IE_PLACES = (
    "Ireland", "Dublin", "Cork", "Galway", "Limerick", "Waterford", "Belfast", "Remote", "Hybrid",
)

AE_PLACES = (
    "United Arab Emirates", "UAE", "Dubai", "Abu Dhabi", "Sharjah", "Ajman", "Remote", "Hybrid",
)

#: Where priority is higher in market ch; the queue's reasons know more of the same region.
ROMANDIE = (
    "geneve", "geneva", "lausanne", "vaud", "neuchatel", "jura", "fribourg", "valais", "sion", "nyon", "montreux",
)

ROMANDIE_MORE = (
    "morges", "gland", "yverdon",
)

# Search terms.

BE_TERMS = (
    "devops", "junior devops", "cloud engineer", "junior cloud engineer", "site reliability engineer", "sre", "platform engineer", "systems engineer",
    "system engineer", "systems administrator", "system administrator", "linux system administrator", "junior linux administrator",
    "windows system administrator", "endpoint administrator", "intune administrator", "infrastructure engineer", "it operations engineer",
    "operations engineer", "production support engineer", "application support engineer", "cloud support engineer", "ci/cd", "release engineer",
    "build engineer", "terraform", "ansible", "kubernetes", "docker", "azure", "azure administrator", "azure engineer", "test automation engineer",
    "qa automation engineer", "administrateur systemes", "administrateur systèmes", "administrateur reseau", "administrateur réseau",
    "gestionnaire exploitation informatique", "technicien exploitation informatique", "ingenieur exploitation informatique",
    "ingenieur production informatique", "technicien systemes reseaux", "technicien systèmes réseaux", "technicien reseau",
    "ingenieur systemes reseaux", "gestionnaire reseau", "chargé exploitation informatique",
)

CH_TERMS = (
    "junior system administrator", "system administrator", "linux system administrator", "systems administrator", "network administrator",
    "network engineer", "administrateur systeme", "administrateur reseau", "ingenieur systeme", "ingenieur reseau", "it support",
    "it support specialist", "technical support engineer", "support informatique", "technicien support", "helpdesk it", "service desk",
    "service desk engineer", "application support engineer", "test automation engineer", "qa automation engineer", "build engineer",
    "release engineer", "ict system engineer", "it infrastructure specialist", "infrastructure support", "platform support engineer", "cloud support",
    "cloud support engineer", "cloud operations", "it operations", "operations engineer", "junior cloud engineer", "cloud engineer", "devops",
    "devops engineer", "junior devops", "site reliability engineer", "sre", "it trainee", "it intern", "stage informatique", "it graduate program",
    "graduate programme digital and it", "technology graduate program", "entry level it support", "junior it support",
)

MA_TERMS = (
    "devops", "devops engineer", "cloud engineer", "platform engineer", "system administrator", "systems administrator", "linux administrator",
    "linux system administrator", "infrastructure engineer", "systems engineer", "system engineer", "network engineer", "network administrator",
    "it support", "technical support", "application support", "operations engineer", "it operations", "cloud support", "automation engineer",
    "administrateur systeme", "administrateur systèmes", "administrateur reseau", "administrateur réseau", "ingenieur systeme", "ingénieur système",
    "ingenieur infrastructure", "ingénieur infrastructure", "support informatique", "technicien support",
)

NL_TERMS = (
    "devops engineer", "devops", "junior devops", "cloud engineer", "junior cloud engineer", "site reliability engineer", "sre", "platform engineer",
    "system administrator", "linux system administrator", "infrastructure engineer", "it operations engineer", "cloud support engineer",
    "cloud operations", "automation engineer", "build engineer", "release engineer", "kubernetes engineer", "azure engineer", "azure administrator",
    "cloud graduate", "it graduate", "graduate program",
)

DE_TERMS = (
    "devops engineer", "devops", "junior devops", "cloud engineer", "junior cloud engineer", "site reliability engineer", "sre", "platform engineer",
    "system administrator", "linux system administrator", "infrastructure engineer", "it operations engineer", "cloud support engineer",
    "cloud operations engineer", "automation engineer", "build engineer", "release engineer", "kubernetes engineer", "azure engineer",
    "azure administrator", "cloud graduate", "it graduate", "graduate program",
)

FR_TERMS = (
    "devops engineer", "devops", "junior devops", "cloud engineer", "junior cloud engineer", "site reliability engineer", "sre", "platform engineer",
    "system administrator", "linux system administrator", "infrastructure engineer", "cloud support engineer", "cloud operations",
    "automation engineer", "build engineer", "release engineer", "azure engineer", "azure administrator", "ingenieur devops", "ingenieur cloud",
    "ingenieur infrastructure", "administrateur systeme", "administrateur systemes", "ingenieur systeme", "ingenieur systemes",
    "administrateur linux", "ingenieur devops junior", "ingenieur cloud junior", "stagiaire devops", "alternant devops", "technicien systeme",
    "technicien infrastructure", "gestionnaire exploitation informatique", "technicien exploitation informatique",
    "ingenieur production informatique", "administrateur reseau", "gestionnaire reseau", "ingenieur systemes reseaux", "technicien systemes reseaux",
)

GB_TERMS = (
    "devops engineer", "devops", "junior devops", "cloud engineer", "junior cloud engineer", "site reliability engineer", "sre", "platform engineer",
    "system administrator", "linux system administrator", "infrastructure engineer", "cloud support engineer", "cloud operations engineer",
    "automation engineer", "build engineer", "release engineer", "azure engineer", "azure administrator", "kubernetes engineer", "cloud graduate",
    "graduate program", "it graduate",
)

AE_TERMS = (
    "devops engineer", "devops", "cloud engineer", "site reliability engineer", "sre", "platform engineer", "system administrator",
    "linux administrator", "infrastructure engineer", "cloud support engineer", "cloud operations", "azure engineer", "azure administrator",
    "kubernetes engineer", "automation engineer",
)

#: Pages to ask for of a term; of others DEFAULT_PAGES.
TERM_PAGES = (
    ("devops", 4), ("devops engineer", 4), ("devops intern", 3), ("devops graduate", 3), ("graduate devops", 3), ("graduate program", 2),
    ("young graduate", 2), ("cloud support", 4), ("cloud support engineer", 4), ("cloud support intern", 3), ("cloud engineer", 3),
    ("cloud graduate", 3), ("cloud engineer intern", 3), ("junior cloud engineer", 3), ("cloud intern", 3), ("system administrator", 3),
    ("system administrator intern", 3), ("linux system administrator", 3), ("linux system administrator intern", 3), ("platform engineer", 3),
    ("platform engineer intern", 3), ("site reliability engineer", 3), ("sre", 3), ("operations engineer", 3), ("it operations", 3), ("it intern", 3),
    ("it trainee", 3), ("stagiaire devops", 3), ("stagiaire cloud", 3), ("kubernetes", 2), ("docker", 2),
)

DEFAULT_PAGES, RESULTS_PER_PAGE = 2, 50

#: What a term in the text adds to priority.
TERM_WEIGHTS = (
    ("cloud support", 6), ("cloud operations", 6), ("cloud engineer", 5), ("junior cloud engineer", 5), ("system administrator", 5),
    ("linux system administrator", 5), ("devops engineer", 4), ("devops", 4), ("site reliability engineer", 4), ("platform engineer", 3),
)

#: Of market ch besides; the same term's weight replaces the one above.
CH_TERM_WEIGHTS = (
    ("it support", 8), ("support informatique", 8), ("application support engineer", 8), ("system administrator", 8),
    ("linux system administrator", 8), ("cloud support", 8), ("it operations", 7), ("operations engineer", 7), ("network operations engineer", 7),
    ("security operations engineer", 6), ("it trainee", 6), ("it intern", 6), ("stage informatique", 5), ("junior", 4), ("graduate", 3),
)

# Titles, roles and excluded words.

#: Padded entries match inside a title only.
BAD_TITLES = (
    "senior", "medior", "mid-level", "mid level", "principal", "expert", " l3 ", "(qa)", "hr graduate", "it analyst graduate", " staff ",
    "staff engineer", "staff platform", "staff sre", "sr. ", "sr ",
)

CH_BAD_TITLES = (
    "sr ", " sr ",
)

FR_BAD_TITLES = (
    "confirmé", "confirme", "confirmée",
)

EXCLUDED = (
    "senior", "medior", "expert", "principal", "architect", "lead", "team lead", "tech lead", "chapter lead", "manager", "head of", "director",
    "staff engineer", "freelance", "independent consultant", "consultant senior", "consulting lead", "end-to-end responsibility", "strategic mindset",
    "make architectural decisions", "design scalable systems", "design cloud solutions", "experience in data center", "experience en data center",
    "data center europeen", "migration des infrastructures", "migrate infrastructure", "security clearance", "clearance", "secret clearance",
    "top secret", "nato", "cosmic", "defense", "defence", "military", "classified", "consultant", "consulting", "contractor", "architectuur",
    "enterprise architect", "solution architect", "data consultant", "consultant data", "cloud & data", "data engineer", "data analyst",
    "business intelligence", "bi consultant", "machine learning", "ml engineer", "nlp", "ai engineer", "artificial intelligence", "embedded",
    "embedded software", "firmware", "hardware", "video engineer", "software test engineer", "rail traffic data", "landfill", "wastewater treatment",
    "sewage treatment", "waste water treatment", "lisbon and san francisco", "offices in both lisbon", "u.s. federal government",
    "us federal government", "cross domain solution", "cross domain solutions", "government clearance",
)

CH_EXCLUDED = (
    "civil infrastructure", "planificateur", "dessinateur", "developpeur web", "developpeuse web", "developpeur full stack",
    "developpeuse full stack", "developpeur fullstack", "developpeuse fullstack", "integrateur web", "apprenticeship", "apprentissage", "apprenti",
    "cfc", "formateur", "trainer",
)

FR_EXCLUDED = (
    "alternance", "alternant", "stage de fin d'etudes", "stage de fin d etudes", "stage fin d'etudes", "stage - ", "bts sio", "bts informatique",
    "master 1", "master 2", "bac+3", "bac+4", "bac+5", "habilitation securite", "habilitation de securite", "secret defense", "secret défense",
    "diffusion restreinte", "confidentiel defense", "confidentiel défense", "ts/sci",
)

#: Phrases taken out before excluded words are looked for.
EXCLUDED_EXCEPTIONS = (
    "under guidance from senior", "under guidance of senior", "guidance from senior", "under supervision of senior", "supervision of senior",
    "mentored by senior", "mentored by a senior", "supported by senior", "working with senior engineers", "supporting senior engineers",
    "reporting to senior", "reports to senior", "managerial team", "accountmanager", "vergelijkbare vacatures senior", "user hardware",
    "hardware and peripherals", "grow into senior", "path into senior", "escalate to senior", "work with senior",
)

#: Excluded words that are soft outside the title.
TITLE_ONLY = (
    "manager", "lead", "director", "head", "head of", "principal", "expert", "architect", "team lead", "tech lead",
)

ROLES = (
    "devops", "devops engineer", "devops intern", "devops internship", "devops graduate", "graduate devops", "young graduate", "cloud intern",
    "cloud engineer intern", "cloud support intern", "stagiaire devops", "stagiaire cloud", "trainee devops", "cloud engineer", "cloud support",
    "cloud support engineer", "cloud operations", "cloud operations engineer", "cloud operations specialist", "platform engineer",
    "site reliability engineer", "sre", "linux system administrator", "linux administrator", "linux admin", "linux engineer", "system administrator",
    "systems administrator", "system engineer", "systems engineer", "infrastructure engineer", "infra engineer", "observability",
    "monitoring engineer", "monitoring specialist", "automation engineer", "cicd", "ci/cd", "build engineer", "release engineer", "pipeline engineer",
    "reliability engineer", "devsecops", "security operations",
)

CH_ROLES = (
    "devops", "devops engineer", "junior devops", "cloud engineer", "junior cloud engineer", "cloud support", "cloud support engineer",
    "cloud operations", "platform engineer", "site reliability engineer", "sre", "system administrator", "systems administrator",
    "network administrator", "administrateur reseau", "network engineer", "ingenieur reseau", "linux system administrator", "linux administrator",
    "linux admin", "infrastructure engineer", "infrastructure support", "it operations", "operations engineer", "it support",
    "test automation engineer", "qa automation engineer", "build engineer", "release engineer", "ict system engineer", "it infrastructure specialist",
    "technical support engineer", "support engineer", "support informatique", "helpdesk", "service desk", "application support", "platform support",
    "network support", "it trainee", "it intern", "stage informatique", "it specialist", "computer scientist", "application support engineer",
    "network operations engineer", "security operations engineer",
)

MA_ROLES = (
    "devops", "devops engineer", "cloud engineer", "cloud support", "cloud support engineer", "cloud operations", "platform engineer",
    "system administrator", "systems administrator", "linux system administrator", "linux administrator", "system engineer", "systems engineer",
    "infrastructure engineer", "network engineer", "network administrator", "support informatique", "it support", "technical support",
    "support technique", "service desk", "helpdesk", "help desk", "application support", "technicien support", "technicien it",
    "technicien informatique", "technicien en informatique", "technicien support informatique", "technicien reseau informatique",
    "technicien en reseaux informatiques", "technicien si", "techniciens si", "technicien informaticien", "informaticien", "it support specialist",
    "ingenieur systemes d information", "systemes d information", "software engineer", "software developer", "full stack", "fullstack",
    "backend developer", "backend engineer", "frontend developer", "web developer", "developpeur full stack", "developpeur backend",
    "developpeur frontend", "concepteur developpeur", "java developer", "python developer", "dotnet developer", ".net developer", "data engineer",
    "data analyst", "business intelligence", "bi developer", "power bi", "data scientist", "machine learning", "ai engineer", "ingenieur ia",
    "qa engineer", "qa tester", "test engineer", "test analyst", "test automation", "automation qa",
)

FORBIDDEN_ROLES = (
    "sql database administrator", "database administrator", " dba ", "coo", "chief operating officer", "quality & systems", "ingenieur qualite",
    "cyber security specialist", "mergers & acquisitions", "m&a", " l3 ", "sales", "account executive", "account manager", "vendeur", "vendeuse",
    "business developer", "business development", "inside sales", "customer success", "store", "shop", "cashier", "receptionist", "hostess", "host",
    "chauff", "driver", "livreur", "magasinier", "marketing", "product marketer", "digital marketer", "seo ", "sea ", "sem ", "quality coordinator",
    "quality officer", "project coordinator", "office assistant", "administrative assistant", "data scientist", "data analyst",
    "business intelligence", "bi consultant", "power bi", "tableau developer", "machine learning", "ml engineer", "nlp", "ai engineer",
    "artificial intelligence", "consultant data", "data engineer", "frontend developer", "front end developer", "front-end developer", "fullstack",
    "full stack", "full-stack", "backend developer", "back-end developer", "back end developer", "java developer", "javascript developer",
    "react developer", ".net developer", "php developer", "web developer", "software engineer", "software developer", "content moderator",
    "java graduate", "java academy", "analytics graduate", "business analytics graduate", "supply chain graduate", "supply chain engineering",
    "as a mid level", "as a mid-level", "as a midlevel", "mid-level engineer", "mid level engineer", "seeking a mid", "we need a mid",
    "looking for a mid", "confirmed engineer", "ingenieur confirme", "power tools", "cordless technology", "floorcare", "coding trainee",
    "programming trainee", "coding apprentice", "bootcamp trainee", "ecologist", "hotel management", "aquatic", "health, safety", "health safety",
    "wellbeing graduate", "management graduate programme", "java automation", "java automation engineer", "job guaranteed",
    "launch your cyber security career", "career programme", "plc", "delta v", "deltav", "scada", "dcs ", "ladder logic", "automation system",
    "rockwell", "siemens tia portal", "siemens step7", "allen-bradley", "automate industriel",
)

CH_FORBIDDEN_ROLES = (
    "global mobility", "audit", "financial accounting", "civil infrastructure", "planificateur", "dessinateur", "applied ai", "ai platform",
    "electrical reference", "relocation to sofia", "bulgaria", "developpeur web", "developpeuse web", "developpeur full stack",
    "developpeuse full stack", "developpeur fullstack", "developpeuse fullstack", "developpeur frontend", "developpeuse frontend",
    "developpeur front end", "developpeuse front end", "developpeur backend", "developpeuse backend", "integrateur web",
)

MA_FORBIDDEN_ROLES = (
    "ingenieur commercial", "commercial it", "avant-vente", "avant vente", "proxy product owner", "product owner", "support applicatif",
    "application support analyst", "conseiller de clientele", "customer care", "customer service", "charge d'affaires", "assistante administrative",
    "administrative et commerciale", "administration et data analyse", "data analyse", "responsable paie", "testeur informatique", "test analyst",
    "qa tester", "qa analyst", "qos analyst", "test automatise",
)

SPEED_ROLES = (
    "system administrator", "systems administrator", "system admin", "sysadmin", "junior sysadmin", "cloud support", "cloud support engineer",
    "platform support", "platform support engineer", "application support", "application support engineer", "release engineer", "build engineer",
    "test automation", "test automation engineer", "qa automation", "qa automation engineer", "endpoint administrator", "endpoint admin", "intune",
    "entra", "m365", "microsoft 365",
)

TITLE_BLOCKERS = (
    "electronic warfare", "ertms", "etcs", "railway", "train control", "train operation", "rolling stock", "rf system", "radio frequency", "rf test",
    "rf analysis", "critical environment technician", "data center technician", "datacenter technician", "data centre technician",
    "safety specialist", "safety engineer", "visiting growth", "growth associate", "supply chain engineering", "supply chain engineer",
    "high frequency trading", "high-frequency trading", "satellite payload", "modelling and simulation", "lims", "laboratory system", "chassis",
    "powertrain", "embedded control", "functional safety", "civil/structural", "structural infrastructure", "civil infrastructure engineer",
    "warehouse automation", "back end engineer", "backend engineer", "clinical graduate", "clinical engineer", "clinical specialist", "game security",
    "game engineer", "ran network", "ran engineer", "radio access network", "c++ ecosystem", "build engineer c++", "investments & banking",
    "investment & banking", "site design engineer",
)

PRIMARY_TITLES = (
    "devops", "sre", "site reliability", "platform engineer", "cloud engineer", "cloud operations", "system administrator", "sysadmin",
    "linux administrator", "infrastructure engineer", "it support", "service desk", "helpdesk", "application support",
)

INFRA_EVIDENCE = (
    "kubernetes", "docker", "terraform", "ansible", "ci/cd", "linux", "azure", "aws", "gcp", "observability", "incident management",
    "infrastructure as code", "iac", "helm", "prometheus",
)

INDUSTRIAL = (
    "plc", "scada", "hvac", "bms", "siemens s7", "process control", "electrical", "automation industrielle", "industrial automation", "ertms", "etcs",
    "railway signalling", "railway signaling", "train control", "rolling stock", "railway system", "electronic warfare", "radar system", "rf system",
    "radio frequency", "lims", "laboratory information", "satellite payload", "modelling and simulation", "chassis control", "chassis engineer",
    "automotive r&d", "powertrain", "u.s. federal government", "us federal government", "cross domain solution", "cross domain solutions",
    "government clearance", "materials engineering solution", "chip-making equipment", "semiconductor equipment", "production of plastics",
    "latex binders", "plastics and latex", "warehouse automation engineer", "operational strategies for various projects within",
)

ALIASES = (
    "platform engineer", "infra engineer", "infrastructure engineer", "linux engineer", "sysadmin", "system administrator",
    "cloud operations engineer", "cloud operations", "cloud infrastructure", "automation engineer",
)

ALIAS_SIGNALS = (
    "ci/cd", "kubernetes", "docker", "terraform", "ansible", "linux", "devops", "sre", "platform", "infrastructure", "cloud", "aws", "azure", "gcp",
    "iac", "helm",
)

FALLBACK_TITLES = (
    "it support", "support it", "support informatique", "helpdesk", "service desk", "servicedesk", "technicien support", "support n1", "support n2",
    "support n3", "technical support", "support technique", "it supporter", "ict supporter", "supporttechniker", "it-support",
    "it support specialist", "application support", "administrateur systeme", "administrateur systemes", "administratrice systeme",
    "administratrice systemes", "system administrator", "systems administrator", "network administrator", "administrateur reseau", "network engineer",
    "ingenieur reseau", "system admin", "systemadministrator", "it-systemadministrator", "it administrator", "it administratorin", "it-administrator",
    "ingenieur systeme", "ingenieur systemes", "ingenieur linux", "ict system engineer", "it infrastructure specialist", "test automation engineer",
    "qa automation engineer", "build engineer", "release engineer", "informaticien", "informatiker",
)

TRAINING = (
    "graduate", "trainee", "intern", "internship", "stagiaire", "praktikant", "stage", "entry level", "formation",
)

TRAINING_SUBJECTS = (
    "ict", "computer", "informatique", "informaticien", "informatiker", "cloud", "linux", "kubernetes", "docker", "terraform", "ansible", "devops",
    "network engineer", "network administrator", "system administrator", "sysadmin", "platform engineer", "sre", "site reliability",
    "application support", "helpdesk", "service desk", "ci/cd", "cicd", "aws", "azure", "gcp",
)

TRAINING_TITLES = (
    "cloud", "linux", "devops", "platform", "sre", "ict", "network", "infrastructure engineer", "system administrator", "systems administrator",
    "it support", "it infrastructure",
)

COMMERCIAL = (
    "sales", "business development", "account executive", "account manager", "inside sales", "quota", "prospect", "pipeline", "lead generation",
    "cold call", "ingenieur commercial", "ingénieur commercial", "responsable commercial", "charge de clientele", "chargé de clientèle",
    "grands comptes",
)

# Tracks, first one with a word wins.

TRACK_INFRA_OPS = (
    "devops", "sre", "platform", "cloud engineer", "cloud operations", "system administrator", "administrateur systeme", "administrateur reseau",
    "network engineer", "system engineer", "infrastructure", "it support", "support informatique", "service desk", "helpdesk", "technicien it",
    "technicien informatique", "technicien support", "technicien si", "systems d information", "systemes d information", "monitoring", "production",
    "exploitation", "noc",
)

TRACK_WEB_BACKEND = (
    "software engineer", "software developer", "full stack", "fullstack", "backend", "frontend", "web developer", "developpeur",
    "concepteur developpeur", "java", "python", ".net", "dotnet", "php", "angular", "react", "node.js", "nodejs", "spring",
)

TRACK_DATA_AI = (
    "data engineer", "data analyst", "data scientist", "business intelligence", "power bi", "etl", "sql", "machine learning", "ml engineer",
    "ai engineer", "ingenieur ia", "big data",
)

TRACK_QA_TEST = (
    "qa engineer", "qa tester", "test engineer", "test analyst", "test automation", "automation qa", "test lead", "validation engineer", "testeur",
)

TRACK_BUSINESS_APPS = (
    "sap", "oracle cloud erp", "dynamics 365", "jira service management", "atlassian", "service management", "as400", "sage x3",
)

TRACK_BONUS = (
    ("infra_ops", 2), ("web_backend", 1), ("data_ai", 1), ("qa_test", 1), ("business_apps", 0), ("other_it", 0),
)

# Experience and seniority.

HARD_EXPERIENCE = (
    "5+ years", "5 years experience", "min 5 years", "minimum 5 years", "at least 5 years", "6+ years", "7+ years", "8+ years", "10+ years",
    "au moins 5 ans", "min. 5 ans", "minimum 5 ans d'experience", "5 ans", "5 years", "experience approfondie", "profil senior", "expert level",
    "senior only", "many years of experience", "extensive experience",
)

SOFT_EXPERIENCE = (
    "2+ years", "2 years experience", "min 2 years", "minimum 2 years", "at least 2 years", "3+ years", "3 years experience", "min 3 years",
    "minimum 3 years", "at least 3 years", "4+ years", "4 years experience", "min 4 years", "minimum 4 years", "at least 4 years", "au moins 2 ans",
    "au moins 3 ans", "au moins 4 ans", "min. 2 ans", "min. 3 ans", "min. 4 ans", "minimum 2 ans d'experience", "minimum 3 ans d'experience",
    "minimum 4 ans d'experience", "experience confirmee", "experience significative", "experience solide", "profil confirme", "3 a 5 ans",
    "3-5 years", "strong experience", "solide experience", "advanced knowledge", "in-depth knowledge", "deep knowledge", "broad experience",
)

LEAD_TITLES = (
    "lead", "team lead", "tech lead", "technical lead", "chapter lead", "manager", "head of", "director",
)

SENIOR_TITLES = (
    "architect", "director", "head of", "lead", "manager", "principal", "senior", "sr", "staff engineer",
)

# Roles that a recheck takes out.

APPRENTICESHIP = (
    "apprenticeship", "apprenti", "apprentissage", "cfc", "formation initiale",
)

TRAINER = (
    "formateur", "trainer", "instructor", "enseignant",
)

INFRA = (
    "devops", "cloud", "linux", "kubernetes", "terraform", "ansible", "sre", "platform", "infrastructure", "network", "system administrator",
    "systems administrator", "application support engineer", "application support",
)

INFRA_TITLES = (
    "devops", "cloud", "linux", "infrastructure", "platform", "network", "system administrator", "systems administrator",
    "application support engineer", "application support",
)

SENIOR_NETWORK = (
    "bgp", "ospf", "vxlan", "mpls", "ccnp", "ccie", "sdwan", "5000 users", "5 000 users", "5k users",
)

FINANCE = (
    "finance", "financial", "accounting", "comptabil", "trader", "trading", "credit",
)

BUSINESS_ANALYSIS = (
    "business analyst", "analyste fonctionnel", "functional analyst",
)

MANUAL_QA = (
    "test analyst", "manual tester", "manual testing",
)

INDUSTRIAL_TITLES = (
    "electrical", "electric", "electrique", "process engineer", "production engineer", "plc", "scada", "instrumentation", "robotics", "mecanique",
    "mechanical",
)

QA_BRIDGE = (
    "test automation", "qa automation", "cicd", "ci/cd", "devops", "pipeline", "build", "release",
)

CORE_TITLES = (
    "devops", "cloud", "platform", "sre", "system administrator", "systems administrator", "linux", "test automation", "qa automation",
    "build engineer", "release engineer", "application support engineer",
)

#: Excluded words that a recheck takes for certain, and those that it leaves to a human.
CERTAIN_EXCLUDED = (
    "3+ years", "4+ years", "5+ years", "6+ years", "7+ years", "8+ years", "10+ years", "min 3 years", "minimum 3 years", "at least 3 years",
    "min 4 years", "minimum 4 years", "at least 4 years", "min 5 years", "minimum 5 years", "at least 5 years", "au moins 3 ans", "au moins 4 ans",
    "au moins 5 ans", "minimum 3 ans d'experience", "minimum 4 ans d'experience", "minimum 5 ans d'experience", "experience confirmee", "clearance",
    "security clearance", "secret clearance", "top secret", "defense", "defence", "military", "classified",
)

DOUBTFUL_FORBIDDEN = (
    "coo", "delivery", "store", " l3 ", "software engineer", "artificial intelligence", "data engineer",
)

# Scores.

JUNIOR_PLUS = (
    "junior", "young graduate", "graduate program", "starter", "entry level", "trainee", "training program", "traineeship", "alternance", "intern",
    "internship", "stage", "stagiaire", "0-2 years", "0-3 years", "1-2 years experience", "1 to 2 years", "school leaver", "willing to learn",
    "training provided", "no experience required", "new graduate", "young talent",
)

JUNIOR_MINUS = (
    "strong experience", "solid experience", "proven experience", "seasoned", "track record", "in-depth knowledge", "deep knowledge", "expertise in",
    "hands-on experience in multiple", "broad experience", "many years of experience", "extensive experience", "cloud architect", "devops architect",
    "senior devops", "senior cloud engineer", "senior site reliability", "team lead", "technical lead", "tech lead", "make architectural decisions",
    "design scalable systems", "design cloud solutions",
)

JUNIOR_MILD = (
    "5 years", "5+ years", "4 years", "4+ years", "3+ years", "manage stakeholders", "end-to-end responsibility", "strategic", "strategic mindset",
    "contractor", "consultant",
)

HIRING_PLUS = (
    "junior", "graduate", "trainee", "entry level", "training provided", "will be trained", "we hire for potential", "no prior experience required",
    "no experience required", "starter",
)

HIRING_MINUS = (
    "team lead", "technical lead", "tech lead", "head of", "director", "principal", "staff engineer", "senior", "architect", "contractor",
    "freelance",
)

PRIORITY_TRAINING = (
    "junior", "trainee", "intern", "internship", "entry level", "training provided", "no experience required", "graduate",
)

SPONSOR_PLUS = (
    "visa sponsorship", "sponsorship provided", "we sponsor", "will sponsor", "work permit sponsorship", "relocation package", "relocation support",
    "relocation assistance", "relocation budget", "relocation provided", "we support relocation", "international candidates welcome",
    "international candidates encouraged", "open to candidates from abroad", "open to international", "global talent", "employer sponsorship",
    "permit sponsorship", "we provide sponsorship", "happy to sponsor", "sponsoring the visa", "work authorization supported",
)

SPONSOR_MINUS = (
    "no sponsorship", "no visa sponsorship", "cannot sponsor", "cannot offer visa sponsorship", "role cannot offer visa sponsorship",
    "this role cannot offer", "unable to sponsor", "unable to offer sponsorship", "not in a position to sponsor", "not providing sponsorship",
    "not providing relocation sponsorship", "not able to provide sponsorship", "not offering sponsorship", "we cannot offer",
    "sponsorship not available", "no work permit", "eu passport required", "eu citizenship required", "eu citizens only", "eu residents only",
    "must have right to work", "already authorized to work", "must be authorized to work", "no relocation assistance", "no relocation support",
    "no relocation budget", "uk national", "must be a uk national", "must be uk based", "must live within", "existing work authorization",
    "existing eu work authorization", "existing netherlands work authorization", "right to work in", "work authorization required",
    "only candidates with existing", "sponsership is not provided", "sponsership not provided", "no sponsership", "sponsorship is not provided",
    "sponsoring is not provided",
)

SPONSORS = (
    "amazon", "amazon web services", "microsoft", "google", "meta", "apple", "netflix", "ibm", "oracle", "salesforce", "cisco", "vmware", "intel",
    "nvidia", "qualcomm", "ericsson", "nokia", "swift", "mastercard", "visa", "bloomberg", "asml", "booking.com", "adyen", "philips", "shell",
    "ing bank", "abn amro", "rabobank", "heineken", "randstad", "wolters kluwer", "nxp semiconductors", "tomtom", "siemens", "bosch",
    "deutsche telekom", "zalando", "delivery hero", "allianz", "deutsche bank", "sap se", "capgemini", "accenture", "atos", "cgi", "sopra steria",
    "devoteam", "fujitsu", "infosys", "wipro", "tata consultancy", "cognizant", "deloitte", "kpmg", "ernst & young", "pricewaterhousecoopers",
    "cloudflare", "datadog", "hashicorp", "gitlab", "github", "stripe", "hubspot", "workday", "airbnb", "linkedin", "barclays", "hsbc", "lloyds",
    "natwest", "bt group", "bt ", "sky ", "vodafone", "arm ", "sage ", "sopra steria", "thales", "orange", "atos", "dassault", "noon",
    "property finder", "talabat", "dubizzle",
)

GLOBAL_SIGNALS = (
    "presence in", "offices in", "worldwide", "internationally", "global company", "global team", "international team", "multinational",
    "across countries", "across the globe",
)

# The queue of market ma.

MA_QUEUE_LANGUAGES = (
    ("nl", ("neerlandais", "nederlands", "dutch", "dutch-speaking",)),
    ("de", ("germanophone", "german", "deutsch", "allemand",)),
    ("es", ("hispanophone", "hispano", "spanish", "espagnol",)),
    ("tr", ("turkish", "turc", "turcophone",)),
    ("it", ("italophone", "italien", "italiano",)),
)

MA_QUEUE_TITLES = (
    ("product_owner", ("proxy product owner", "product owner",)),
    ("app_support", ("support applicatif", "application support",)),
    ("customer_service", ("conseiller de clientele", "customer care", "customer service",)),
    ("qa_testing", ("testeur", "qa", "quality assurance",)),
    ("internship", ("stagiaire", "stage ", " stage", "internship", "intern ",)),
)

MA_CLEAR_TITLES = (
    "junior infra", "technicien it", "technicien informatique", "technicien en informatique", "technicien support informatique", "technicien reseau",
    "technicien si", "technicien support", "help desk", "helpdesk", "service desk", "support it", "support technique", "administrateur systeme",
    "administrateur reseau", "system engineer", "systems engineer", "infrastructure engineer", "network engineer", "network administrator",
    "devops engineer", "cloud engineer", "platform engineer", "ingenieur reseaux", "ingenieur systeme", "ingenieur systemes d information",
    "ingenieur infrastructure",
)

MA_GENERIC_TITLES = (
    "ingenieur anglophone", "ingenieur francophone", "ingenieur germanophone", "ingenieur hispanophone", "ingenieur italophone",
    "ingenieur turcophone",
)

MA_CLUSTERS = (
    ("rabat", ("rabat", "sale", "sale ", "salé", "technopolis", "skhirat", "temara", "temara", "témara",)),
    ("casablanca", ("casablanca", "mohammedia", "bouskoura", "nouaceur", "sidi maarouf", "sidi maârouf",)),
    ("tanger", ("tanger", "tangier", "tetouan", "tetouan", "tétouan",)),
    ("rabat_or_remote", ("rabat", "sale", "sale ", "salé", "technopolis", "skhirat", "temara", "temara", "témara",)),
)
