"""The word lists, patterns and base scores that results depend on, stated as they are."""

# ---- fixed values: labels and context words
NAME_LABELS = ["받는분", "받으실분", "수취인", "수하인", "보내는분", "보내시는분", "송하인", "발송인", "성명", "이름", "고객명", "예금주", "주문자", "보낸사람", "받는사람", "작성자", "신청자", "보호자", "환자명", "수진자"]
TRACKING_LABELS = ["운송장번호", "송장번호", "운송장", "등기번호", "택배번호"]
BIRTH_LABELS = ["생년월일", "출생일", "생일"]
HEALTH_WORDS = ["처방", "진료", "진단", "약품명", "복약", "조제", "투약", "의료기관", "환자명", "수진자"]
ACCOUNT_WORDS = ["계좌번호", "계좌", "예금주", "입금", "송금", "이체", "무통장", "가상계좌"]
SECRET_LABELS = ["비밀번호", "비번", "패스워드", "암호", "password", "passwd", "pw", "pin", "도어락", "현관번호", "공동현관"]
ID_LABELS = ["학번", "사번", "사원번호", "학생번호", "직원번호", "교번", "수험번호"]
PUBLIC_MAILBOXES = ["help", "cs", "info", "support", "admin", "contact", "service", "webmaster", "noreply", "no-reply", "master", "sales", "biz", "hr", "recruit"]
CONTEXT_PERSONAL = ["수취인", "받는분", "받는 분", "받으실분", "받으실 분", "수하인", "보내는분", "보내는 분", "송하인", "발송인", "고객명", "성명", "이름", "연락처", "휴대폰", "휴대전화", "전화", "보낸사람", "보낸 사람", "받는사람", "받는 사람", "작성자", "신청자", "보호자", "배송지", "주소", "도착지", "설치주소", "거주지"]
CONTEXT_PUBLIC = ["고객센터", "고객상담", "상담센터", "콜센터", "대표번호", "대표전화", "대표", "문의", "안내", "ARS", "본사", "지사", "지점", "매장", "영업소", "사업자", "사업자등록번호", "상호", "법인", "판매자", "가맹점", "택배문의", "배송문의", "반품", "교환", "A/S", "AS센터"]
CONTEXT_DOCUMENT = {
    "waybill": ["운송장", "송장", "택배", "배송", "수취인", "받는분", "등기", "우편"],
    "receipt": ["영수증", "합계", "부가세", "결제", "카드승인", "승인번호", "가맹점", "거래일시"],
    "badge": ["사원증", "명찰", "출입증", "소속", "부서", "팀", "사번"],
    "student": ["학생증", "학번", "학과", "대학교", "고등학교", "중학교", "재학"],
}

# ---- fixed values: names
SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예봉경사"
COMPOUND_SURNAMES = ["남궁", "황보", "제갈", "선우", "독고", "사공", "서문"]
GIVEN_SYLLABLES = (
    "가강건결경고광구국규근기길나남녕다단담대덕도동두라란래려련렬령례로록룡류률리린림"
    "마만명모목무문미민바박범별병보복봄봉부분비빈빛산상새서석선설섭성세소솔송수숙순슬승시식신실심"
    "아안애양언엄여연열염영예오옥온완용우욱운웅원월위유윤율은을음의이익인일임"
    "자재정제조종주준중지진찬창채천철초춘충치태택하학한해행현혁형혜호홍화환활황효후훈휘희"
)
NAME_STOPWORDS = ["주소", "연락처", "전화", "전화번호", "정보", "확인", "서명", "고객", "본인", "기재", "없음", "미상", "주문", "배송", "문의", "안내", "참고", "이름", "성명"]
NOT_NAME_SUFFIX = ["역", "점", "식당", "약국", "마트", "나라", "문의", "특가", "상품", "병원", "학교", "센터", "은행", "카드", "택배", "시장", "구청", "동", "로", "길", "관", "집", "국", "탕", "실", "회", "당", "사", "과", "팀", "부", "층", "번", "원장", "구", "산", "문", "형"]

# ---- fixed values: value patterns, base scores and default severities, in scan order
PLATE_LETTERS = "가나다라마거너더러머버서어저고노도로모보소오조구누두루무부수우주바사아자배하허호"
PATTERNS = [
    ("rrn", 0.95, r"(?<!\d)\d{6}[-\s]?[1-8]\d{6}(?!\d)"),
    ("rrn_unverified", 0.55, r"(?<!\d)\d{6}[-\s]?[1-8]\d{6}(?!\d)"),
    ("card", 0.80, r"(?<!\d)(?:\d{4}[-\s]?){3}\d{4}(?!\d)"),
    ("brn", 0.70, r"(?<!\d)\d{3}[-\s]?\d{2}[-\s]?\d{5}(?!\d)"),
    ("mobile", 0.90, r"(?<!\d)01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    ("service_line", 0.90, r"(?<!\d)1(?:5(?:88|77|44|66|99|22)|6(?:00|44|66|88))[-.\s]?\d{4}(?!\d)"),
    ("tollfree", 0.85, r"(?<!\d)080[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    ("landline", 0.75, r"(?<!\d)0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    ("email", 0.90, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("plate", 0.60, rf"(?:[가-힣]{{2}}\s?)?\d{{2,3}}\s?[{PLATE_LETTERS}]\s?\d{{4}}(?!\s?(?:호|동|층|번지|원|번))"),
    ("address_unit", 0.75, r"\d{1,4}\s?동\s?\d{1,4}\s?호|\d{1,3}\s?층\s?\d{1,4}\s?호"),
    ("address_road", 0.65, r"[가-힣A-Za-z0-9]{1,12}(?:대?로|길)\s?\d{1,4}(?!\d)(?:-\d{1,4})?(?:번길\s?\d{1,4})?(?!\d|\s?(?:개|명|번째|시간|시|분|초|원|일|월|년|회|차|가지|kg|km|%))"),
    ("long_digits", 0.35, r"(?<![\d-])\d(?:-?\d){9,13}(?![\d-])"),
]
DEFAULT_SEVERITY = {"rrn": "cover", "rrn_unverified": "review", "card": "cover", "mobile": "review", "landline": "review", "email": "review", "address_road": "review", "address_unit": "cover", "plate": "review", "service_line": "info", "tollfree": "info", "brn": "info", "long_digits": "info"}
CONTEXT_IMMUNE = ["service_line", "tollfree", "brn", "long_digits", "rrn", "card"]
SEVERITY_RANK = {"cover": 0, "review": 1, "info": 2}
COMBINATIONS = [["mobile", "address_road"], ["mobile", "address_unit"], ["landline", "address_road"], ["address_road", "address_unit"], ["mobile", "email"], ["name", "mobile"], ["name", "address_road"], ["name", "address_unit"], ["name", "account"], ["name", "student_id"], ["name", "birth_date"]]
COMBINATION_ORDER = ["name", "birth_date", "student_id", "mobile", "landline", "email", "address_road", "address_unit", "account"]
