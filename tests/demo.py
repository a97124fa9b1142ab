"""A small demo database with known personal data, made by arithmetic."""

from palimpsest.lifecycle import Database
from palimpsest.sources.introspect import Constraints

FAMILY = ["Орлов", "Сомов", "Дятлов", "Журавин", "Лебедин", "Соколин", "Щеглов"]
GIVEN = ["Пётр", "Иван", "Семён", "Егор", "Фома"]
CITIES = ["Псков", "Тула", "Елец", "Шуя"]
MARITAL = ["холост", "женат", "разведён", "вдов"]


def inn(n: int) -> str:
    d = f"{50 + n % 40:02d}{n * 7919 % 10**8:08d}"
    for weights in ((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)):
        d += str(sum(int(c) * w for c, w in zip(d, weights)) % 11 % 10)
    return d


def snils(n: int) -> str:
    d = f"{n * 104729 % 10**9:09d}"
    total = sum(int(c) * (9 - i) for i, c in enumerate(d))
    control = total if total < 100 else 0 if total <= 101 else total % 101 % 100
    return f"{d[:3]}-{d[3:6]}-{d[6:]} {control:02d}"


def database(spark, clients: int = 60, orders: int = 150) -> Database:
    def name(n):
        return f"{FAMILY[n % 7]} {GIVEN[n % 5]} Лукич"

    people = [
        (n, f"User{n}@mail.example", name(n), f"+7999{n:07d}", inn(n), snils(n), f"{4000 + n % 50} {100000 + n}", f"{1950 + n % 50}-{n % 12 + 1:02d}-15", CITIES[n % 4],
         f"ул. Мира, д. {n}", f'{{"contact_person":"{name(n + 1)}","contact_phone":"+7888{n:07d}","loyalty_points":{n}.50}}', None if n % 9 == 8 else MARITAL[n % 4], ["gold", "base"][n % 2])
        for n in range(clients)
    ]
    columns = "id int, email string, full_name string, phone string, inn string, snils string, client_code string, birth_date string, city string, address string, profile string, marital_status string, segment string"
    bought = [
        (n, f"User{n % clients}@mail.example", ["new", "paid", "sent"][n % 3], f"Звонил {name(n % clients)}, +7999{n % clients:07d}, просил перезвонить" if n % 4 == 0 else "Оставить у двери, спасибо большое за доставку!")
        for n in range(orders)
    ]
    tables = {"clients": spark.createDataFrame(people, columns), "orders": spark.createDataFrame(bought, "id int, client_email string, status string, comment string")}
    tables["clients"] = tables["clients"].withColumn("birth_date", tables["clients"]["birth_date"].cast("date"))
    check = "CHECK ((marital_status)::text = ANY (ARRAY[" + ", ".join(f"'{m}'::text" for m in MARITAL) + "]))"
    constraints = {
        "clients": Constraints(["id"], [["email"]], {}, {"marital_status": check}, {"client_code": "паспорт: серия и номер", "segment": "сегмент", "marital_status": "семейное положение"}, {"profile": "jsonb"}),
        "orders": Constraints(["id"], [], {"client_email": "clients.email"}, types={"comment": "text"}),
    }
    return Database(tables, constraints)


SENSITIVE = {
    "clients.email": "email", "clients.full_name": "full_name", "clients.phone": "phone", "clients.inn": "inn_person", "clients.snils": "snils", "clients.client_code": "passport",
    "clients.birth_date": "birth_date", "clients.city": "city", "clients.address": "postal_address", "clients.profile": "document", "clients.marital_status": "marital_status",
    "orders.client_email": "email", "orders.comment": "free_text",
}
APPROVALS = [
    {"column": "public.clients.city", "sensitive": True, "semanticType": "city", "mode": "Typed", "reason": "a town", "acceptedBy": "owner"},
    {"column": "public.clients.address", "sensitive": True, "semanticType": "postal_address", "mode": "Typed", "reason": "an address", "acceptedBy": "owner"},
    {"column": "public.clients.profile", "sensitive": True, "semanticType": "document", "mode": "Document", "reason": "a document", "acceptedBy": "owner"},
]
