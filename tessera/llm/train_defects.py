"""Train the conditional random field of defects.py: python -m tessera.llm.train_defects FOLDER

Labels come by construction. From a bounded sample of pairs whose answers work something out, clauses are kept as
they are (answer), cut inside the last clause (unfinished), replaced by the problem's wording (echo), taken from
an answer in another language (foreign), followed or replaced by declining sentences (refusal), or replaced by
placeholders (hollow); answers that restate the problem, apologise for a slip, or say why the data do not suffice
stay answers. The field is fitted by gradient ascent on the likelihood of these tags. Every third declining
sentence is kept out of training and measured apart.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from tessera.llm import defects as D

SAMPLE = 8_000  #: most pairs that are used, whatever the size of the table

# Training sentences, composed for this purpose: openings, declining cores and closings by language.
REFUSALS = {
    "en": (
        ("", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologize, but ", "As an AI model, ", "With regret: ", "My apologies: ", "Regrettably, "),
        (
            "I can't help with that", "I cannot assist you here", "I am unable to give an answer", "I won't solve this", "I'm not able to answer this question", "I must decline to respond", "I have to refuse this task",
            "I would rather not work on this", "I don't feel comfortable answering", "this is something I am not permitted to do", "that lies outside of what I may offer", "it goes against my policy to give solutions", "I am not going to complete this exercise",
            "answering this would not be appropriate", "I do not have the means to handle such tasks", "you will get no answer from me", "I decline to work this out", "I'd prefer not to give the result", "I can not provide a solution", "my rules forbid me to answer",
            "I will not be doing this homework for you", "I'm not allowed to solve exercises", "I have been told not to answer questions like this", "I cannot comply with this request", "I do not wish to continue with this calculation", "my instructions do not let me respond to this", "no worked answer will come from me", "a result is not going to be given here", "an answer cannot be supplied", "nothing of the kind will be supplied by me", "no result will be offered by me", "there won't be a solution from me", "no help will be given with this", "it would be wrong of me to hand out a result", "giving a full solution would be inappropriate", "I'd rather leave this unanswered", "I don't want to give the answer", "it is not appropriate that I answer here", "I am prevented from finishing this problem", "I refuse to help with this",
        ),
        ("", "", "Please ask someone else.", "Maybe a tutor can help you.", "Is there something different I could do for you?", "Feel free to ask me something else.", "I hope you understand.", "Try looking it up in a book.", "I can offer advice on how to learn instead.", "Do you have another question?", "Thank you for understanding.", "If you need anything else, just tell me.", "I am happy to talk about other topics.", "Tell me if you want something different.", "Perhaps your class notes are of use."),
    ),
    "de": (
        ("", "", "Leider ", "Entschuldigung, ", "Es tut mir leid, aber "),
        ("dabei kann ich nicht helfen", "ich kann diese Frage nicht beantworten", "ich darf diese Aufgabe nicht lösen", "das möchte ich nicht berechnen", "ich muss das ablehnen", "ich werde hierzu keine Lösung geben", "ich bin nicht in der Lage, das zu bearbeiten", "diese Bitte lehne ich ab", "meine Regeln verbieten mir eine Antwort", "ich verweigere die Bearbeitung", "eine Antwort ist mir nicht gestattet", "das fällt nicht in meinen Bereich, daher keine Antwort von mir", "hier kann ich nicht weiterhelfen", "es ist mir nicht erlaubt, so etwas zu lösen", "lieber gebe ich dazu kein Ergebnis an"),
        ("", "", "Frag bitte jemand anderen.", "Vielleicht hilft dir ein Tutor.", "Kann ich sonst etwas für dich tun?", "Ich bitte um Verständnis.", "Schau in ein Buch."),
    ),
    "fr": (
        ("", "", "Désolé, ", "Malheureusement, ", "Je m'excuse, mais "),
        ("je ne peux pas vous aider", "je ne suis pas en mesure de répondre", "je refuse de résoudre cet exercice", "je dois décliner cette demande", "il ne m'est pas permis de donner la solution", "je préfère ne pas répondre", "mes règles m'interdisent de répondre", "je ne vais pas faire ce devoir", "je ne souhaite pas traiter cette question", "cela ne fait pas partie de ce que je peux faire", "aucune réponse ne sera donnée de ma part", "je n'ai pas le droit de résoudre ce genre de problème", "je ne puis fournir de résultat", "il m'est impossible de traiter votre demande", "je décline cette tâche"),
        ("", "", "Demandez à quelqu'un d'autre.", "Un professeur pourra vous aider.", "Puis-je faire autre chose pour vous ?", "Merci de votre compréhension."),
    ),
    "es": (
        ("", "", "Lo siento, ", "Por desgracia, ", "Disculpa, pero "),
        ("no puedo ayudarte con eso", "no soy capaz de responder", "no voy a resolver este ejercicio", "debo rechazar esta petición", "no me está permitido dar la solución", "prefiero no responder", "mis normas me prohíben contestar", "me niego a hacer esta tarea", "no deseo tratar esta pregunta", "eso queda fuera de lo que puedo hacer", "no daré ninguna respuesta", "no tengo permiso para resolver problemas así", "no puedo proporcionar un resultado", "me es imposible atender tu solicitud", "rechazo esta tarea"),
        ("", "", "Pregunta a otra persona.", "Un profesor te puede ayudar.", "¿Puedo hacer otra cosa por ti?", "Gracias por tu comprensión."),
    ),
    "ru": (
        ("", "", "Извините, ", "К сожалению, ", "Простите, но "),
        ("я не могу помочь с этим", "я не могу ответить на этот вопрос", "я не буду решать эту задачу", "мне придётся отказаться", "мне нельзя давать решение", "я предпочитаю не отвечать", "правила запрещают мне отвечать", "я отказываюсь выполнять это задание", "я не в состоянии дать ответ", "это выходит за рамки того, что мне можно", "ответа от меня не будет", "я не имею права решать такие задачи", "не могу предоставить результат", "вынужден отклонить ваш запрос"),
        ("", "", "Спросите кого-нибудь другого.", "Вам поможет преподаватель.", "Могу ли я помочь чем-то ещё?", "Спасибо за понимание."),
    ),
    "zh": (
        ("", "", "抱歉，", "对不起，", "很遗憾，"),
        ("我不能帮你做这个", "我无法回答这个问题", "我不会解这道题", "我必须拒绝这个请求", "我不被允许给出解答", "我宁愿不回答", "规定禁止我回答", "我拒绝完成这个作业", "我没有能力提供答案", "这超出了我可以做的范围", "我不便给出结果", "我无权解决这类题目", "恕我不能协助", "我无法满足您的要求"),
        ("", "", "请问问别人。", "老师可以帮助你。", "还有什么我可以帮忙的吗？", "谢谢理解。"),
    ),
}
# Sentences that look like it and belong to an answer.
HARMLESS = {
    "en": ("I'm sorry, I copied a digit wrongly above.", "Sorry, that sign was wrong; here it is again.", "We cannot divide by zero, so this case falls away.", "Unfortunately the first attempt leads nowhere, so we try the second.", "It is not possible that both are odd.", "We can't tell more from the picture, but the sum settles it.", "This cannot be negative."),
    "de": ("Entschuldigung, oben steht eine falsche Ziffer.", "Durch null kann man nicht teilen.", "Leider führt der erste Weg nicht weiter.", "Das kann nicht negativ sein."),
    "fr": ("Désolé, j'ai mal recopié un chiffre.", "On ne peut pas diviser par zéro.", "Malheureusement le premier essai échoue.", "Cela ne peut pas être négatif."),
    "es": ("Perdón, copié mal una cifra.", "No se puede dividir por cero.", "Por desgracia el primer intento falla.", "Eso no puede ser negativo."),
    "ru": ("Извините, выше ошибка в цифре.", "На ноль делить нельзя.", "К сожалению, первый способ не работает."),
    "zh": ("抱歉，上面写错了一个数字。", "不能除以零。", "可惜第一种方法行不通。"),
}
# Ends that look broken off and are not.
OPEN_ENDS = {
    "en": ("The same holds for the next terms, and so on...", "The digits repeat: 3, 6, 3, 6, etc.", "We could go on with 5, 7, 9, ... and so forth", "This works for every further step, etc..."),
    "de": ("So geht es weiter mit 5, 7, 9 usw.", "Das gilt auch für alle weiteren Schritte und so weiter..."),
    "fr": ("On continue avec 5, 7, 9, etc.", "Cela vaut aussi pour la suite, et ainsi de suite..."),
    "es": ("Se sigue con 5, 7, 9, etc.", "Vale también para los demás pasos, y así sucesivamente..."),
    "ru": ("Дальше так же: 5, 7, 9 и т. д.", "То же верно и далее, и так далее..."),
    "zh": ("后面依此类推：5, 7, 9等等……", "其余步骤也一样，等等..."),
}
INSUFFICIENT = {
    "en": ("The {} is never stated, so no single value follows. The answer is: the data do not suffice.", "Two different cases fit everything that is given, so the value is not fixed. There is not enough information.", "Without the {} the total cannot be worked out; the problem leaves it open.", "The result cannot be determined, because the {} is missing."),
    "de": ("Die Angabe zu {} fehlt, daher ist der Wert nicht bestimmt. Antwort: Die Angaben reichen nicht aus.", "Zwei Fälle passen zu allem, was gegeben ist; es lässt sich nicht entscheiden."),
    "fr": ("La valeur de {} n'est pas donnée, on ne peut donc pas conclure. Réponse : données insuffisantes.", "Deux cas sont possibles, le résultat n'est pas déterminé."),
    "es": ("Falta el dato de {}, así que el valor no queda fijado. Respuesta: faltan datos.", "Hay dos casos posibles, el resultado no se puede determinar."),
    "ru": ("Значение {} не дано, поэтому ответ не определён. Ответ: данных недостаточно.",),
    "zh": ("题目没有给出{}，所以无法确定。答案：条件不足。",),
}
HOLLOW = (
    "N/A", "n/a", "NA", "None", "none", "null", "nil", "NULL", "NaN", "TODO", "todo", "TBD", "tba", "-", "--", "...", "…", "?", "???", "no answer", "No solution.", "No answer provided", "not available", "Not given", "to be added", "to be done", "answer pending", "pending", "[empty]", "(blank)", "<none>", "empty", "blank", "missing", "undefined",
    "\\boxed{}", "$\\boxed{ }$", "$$ $$", "####", "Answer:", "Solution:", "Final answer:", "The answer is", "The answer is:", "**Answer:**", "Result:", "Proof.", "Response:", "placeholder", "nothing here", "insert solution here", "see above",
    "Antwort:", "Lösung:", "Ergebnis:", "Die Antwort lautet", "keine Antwort", "keine Lösung", "fehlt", "leer", "Réponse :", "Solution :", "Résultat :", "La réponse est", "sans réponse", "pas de solution", "vide", "Respuesta:", "Solución:", "Resultado:", "La respuesta es", "sin respuesta", "vacío", "Ответ:", "Решение:", "нет ответа", "нет решения", "пусто", "答案：", "解：", "解答：", "答案是", "无", "暂无", "空", "没有答案",
)
FRAMES = {"en": ("Question:", "The problem reads:", "You want to know:", "Restated:", "The task:", ""), "de": ("Frage:", "Die Aufgabe lautet:", ""), "fr": ("Question :", "Énoncé :", ""), "es": ("Pregunta:", "El enunciado dice:", ""), "ru": ("Вопрос:", "Условие:", ""), "zh": ("问题：", "题目：", "")}
CUT_MARKS = ("...", "...", "...", "…", " ...", "... [stop]", " […]", " [cut off]", " (cut)", " <eos>", " [output limit]", " -", ",", " --", "... (limit reached)")
_LABELS = {"eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh"}


def label(lang: str | None) -> str | None:
    bare = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return _LABELS.get(bare, bare) or None


def language_scores(rows: list[tuple[str, str, str | None]]) -> np.ndarray:
    """Log shares of letter groups by language, centred; first from problems by label, then from texts that agree with it."""

    def table(texts: list[tuple[str, int]]) -> np.ndarray:
        counts = np.full((D.GRAMS, len(D.LANGS)), 0.5)
        for text, lang in texts:
            for word in set(D.tokens(text)):
                if word.isalpha():
                    np.add.at(counts[:, lang], D.letter_groups(word), 1.0)
        log = np.log(counts / counts.sum(0))
        return np.clip(log - log.mean(1, keepdims=True), -4, 4)

    labelled = [(p, s, D.LANGS.index(lang)) for p, s, raw in rows if (lang := label(raw)) in D.LANGS]
    first = table([(p, k) for p, _, k in labelled])

    def best(grams: np.ndarray, text: str) -> int:
        words = [w for w in D.tokens(text) if w.isalpha()]
        return int(sum(grams[D.letter_groups(w)].mean(0) for w in words).argmax()) if words else -1

    return table([(t, k) for p, s, k in labelled for t in (p, s) if best(first, t) == k])


def worked(field: D.Field, problem: str, solution: str) -> tuple[D.Problem, list[str], str] | None:
    """A pair that most likely has a proper answer: it calculates, in the problem's language, and ends like a text or a result."""
    p, parts = field.problem(problem), D.clauses(solution)
    told = [field.clause(c) for c in parts]
    if not parts or not p.n or not any(not c.numbers <= p.words for c in told):
        return None
    spoken = np.sum([c.lang for c in told], axis=0)
    last = parts[-1].rstrip("*_ ")
    closed = last[-1:] in ".!?。！？∎■" and not last.endswith("...") or bool(told[-1].numbers) and last[-1:] in "0123456789$}%°)"
    if int(spoken.argmax()) != int(p.lang.argmax()) or not closed or any(last.count(a) > last.count(b) for a, b in ("{}", "()", "[]")) or last.count("$") % 2:
        return None
    return p, parts, D.LANGS[int(p.lang.argmax())]


def examples(field: D.Field, rows: list[tuple[str, str, str | None]], seed: int = 7, refusals: slice | None = None) -> list[tuple[str, list[str], list[int], str]]:
    """(problem, clauses, tags, kind); the declining cores whose number is 2 by 3 stay out of training."""
    rng = random.Random(seed)
    good = [(problem, *w) for problem, solution, _ in rows if (w := worked(field, problem, solution))]
    by_lang: dict[str, list[list[str]]] = {}
    for _, _, parts, lang in good:
        by_lang.setdefault(lang, []).append(parts)
    A, R, E, Fo, U, H = range(len(D.TAGS))
    out: list[tuple[str, list[str], list[int], str]] = []

    def plain(parts: list[str]) -> list[int]:
        return [H if c[-1:] in ":：" and len(D.tokens(c)) <= 3 and not any(x.isdigit() for x in c) else A for c in parts]

    def cut(text: str) -> str:
        short = text[: rng.randrange(2, max(3, len(text) - 1))].rstrip()
        return short + (rng.choice(CUT_MARKS) if rng.random() < 0.4 else "")

    def declined(lang: str) -> list[str]:
        opening, cores, closing = REFUSALS[lang]
        core = rng.choice([c for k, c in enumerate(cores) if (k % 3 == 2) == bool(refusals)])
        text = rng.choice(opening) + core
        text = text[:1].upper() + text[1:] + ("。" if lang == "zh" else rng.choice((".", ".", "!")))
        return D.clauses(f"{text} {rng.choice(closing)}")

    def echoed(problem: str, lang: str) -> list[str]:
        words = [w for w in problem.split() if rng.random() > 0.04]
        text = " ".join(words) or problem
        text = rng.choice((str, str, str, str.upper, str.lower))(text)
        if rng.random() < 0.15:
            text = re.sub(r"[^\w\s+*/=^()-]", "", text)
        return D.clauses(text if rng.random() < 0.8 else cut(text)) or [problem]

    for problem, _, parts, lang in good:
        base = plain(parts)
        out.append((problem, parts, base, "answer"))
        for kind in rng.sample(("unfinished", "unfinished", "echo", "restated", "restated-cut", "foreign", "refusal", "refusal", "refusal", "hollow", "harmless", "insufficient", "short", "short", "phrase", "open"), 3):
            if kind == "unfinished" or kind == "restated-cut":
                k = rng.randrange(len(parts))
                if len(parts[k]) < 4:
                    continue
                lead = D.clauses(problem) if kind == "restated-cut" else []
                short = D.clauses(cut(parts[k]))[:1]
                if short and short[0] != parts[k]:
                    out.append((problem, [*lead, *parts[:k], *short], [E] * len(lead) + base[:k] + [U], "unfinished"))
            elif kind == "echo":
                frame = D.clauses(rng.choice(FRAMES[lang]))
                said = echoed(problem, lang)
                if rng.random() < 0.15:
                    said = said * 2
                out.append((problem, frame + said, [H] * len(frame) + [E] * len(said), kind))
            elif kind == "restated":
                frame, said = D.clauses(rng.choice(FRAMES[lang])), D.clauses(problem)
                out.append((problem, [*frame, *said, *parts], [H] * len(frame) + [E] * len(said) + base, "answer"))
            elif kind == "foreign":
                other = rng.choice([x for x in by_lang if x != lang] or [lang])
                if other != lang:
                    said = rng.choice(by_lang[other])
                    out.append((problem, said, [t if t == H else Fo for t in plain(said)], kind))
            elif kind == "refusal":
                lead = rng.choice((0, 0, 1, 2, 3))
                said = declined(lang)
                out.append((problem, parts[:lead] + said, base[:lead] + [R] * len(said), kind))
            elif kind == "hollow":
                said = D.clauses(rng.choice((" ", "\n", " - ")).join([rng.choice((str, str, str.lower, str.upper))(rng.choice(HOLLOW))] * rng.choice((1, 1, 1, 2, 5, 40))))
                out.append((problem, said or ["-"], [H] * len(said or ["-"]), kind))
            elif kind == "harmless":
                k = rng.randrange(len(parts))
                said = D.clauses(rng.choice(HARMLESS[lang]))
                out.append((problem, [*parts[:k], *said, *parts[k:]], base[:k] + [A] * len(said) + base[k:], "answer"))
            elif kind == "insufficient":
                said = D.clauses(rng.choice(INSUFFICIENT[lang]).format(rng.choice(problem.split())))
                lead = rng.choice((0, 0, 1))
                out.append((problem, parts[:lead] + said, base[:lead] + [H if t == H else A for t in plain(said)], "answer"))
            elif kind == "short":  # the result alone, which may also be a number of the problem
                number = rng.choice([w for w in D.tokens(problem) if w[0].isdigit()] or ["7"])
                said = D.clauses(rng.choice((parts[-1], number, number, f"\\boxed{{{number}}}", f"${number}$", f"x = {number}", f"{number} {rng.choice(problem.split())}.")))
                out.append((problem, said, [A] * len(said), "answer"))
            elif kind == "open":
                said = D.clauses(rng.choice(OPEN_ENDS[lang]))
                out.append((problem, parts + said, base + [A] * len(said), "answer"))
            elif kind == "phrase":
                k = rng.randrange(len(parts))
                other = rng.choice(by_lang[rng.choice(list(by_lang))])
                said = [min(other, key=len)]
                if rng.random() < 0.5:  # quoted or in brackets, at the end
                    k = len(parts)
                    open_, close = rng.choice((("(", ")"), ("(“", "”)."), ("„", "“."), ("“", ".”"), ("[", "]."), ("*", ".*"), ("«", "».")))
                    said = [f"{open_}{said[0].rstrip('.!?。')}{close}"]
                out.append((problem, [*parts[:k], *said, *parts[k:]], base[:k] + [A] + base[k:], "answer"))
    # Some pairs have no problem; what does not lean on it is tagged the same.
    return [("", parts, tags, kind) if rng.random() < 0.08 and not {E, Fo} & set(tags) else (problem, parts, tags, kind) for problem, parts, tags, kind in out]


def fit(field: D.Field, data: list[tuple[str, list[str], list[int], str]], epochs: int = 12, rate: float = 0.03, decay: float = 2e-6, seed: int = 7) -> D.Field:
    """Maximum likelihood with Adam; the sums over tag paths by the forward-backward recursion, a batch at a time."""
    n_tags = len(D.TAGS)
    theta = [np.zeros((D.BUCKETS, n_tags)), np.zeros((D.N_DENSE, n_tags)), np.zeros((n_tags, n_tags))]
    moment, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    rng = np.random.default_rng(seed)
    made = []
    all_dense, _, all_ends, _ = field.features([field.problem(d[0]) for d in data], [d[1] for d in data])
    cuts = np.cumsum([len(d[1]) for d in data])[:-1]
    for (_, parts, tags, _), rows, ends in zip(data, np.split(all_dense, cuts), all_ends, strict=True):
        made.append((rows, ends, [field.lexicon_rows(D._SHAPE.sub("0", p))[0] for p in parts], np.array(tags)))
    step, n_steps = 0, epochs * -(-len(made) // 256)
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 256):
            chosen = sorted((made[k] for k in order[at : at + 256]), key=lambda m: -len(m[3]))
            counts = np.array([len(m[3]) for m in chosen])
            offset = np.cumsum(counts) - counts
            dense = np.concatenate([m[0] for m in chosen])
            lexicon = [r for m in chosen for r in m[2]]
            sizes = np.array([len(r) for r in lexicon])
            rows, owner = np.concatenate(lexicon), np.repeat(np.arange(len(sizes)), sizes)
            scale = np.repeat(1 / np.sqrt(sizes), sizes)
            ends = np.array([m[1] for m in chosen])
            last = offset + counts - 1
            rows = np.concatenate([rows, ends.ravel()])
            owner = np.concatenate([owner, np.repeat(last, ends.shape[1])])
            scale = np.concatenate([scale, np.ones(ends.size)])
            keep = rng.random(len(rows)) > 0.15  # words are left out at random, so that no single one decides
            rows, owner, scale = rows[keep], owner[keep], scale[keep] / 0.85
            emit = dense @ theta[1]
            held = theta[0][rows] * scale[:, None]
            for k in range(n_tags):
                emit[:, k] += np.bincount(owner, held[:, k], len(emit))
            steps, n = int(counts[0]), len(chosen)
            inside = np.arange(steps)[None, :] < counts[:, None]
            where = np.minimum(offset[:, None] + np.arange(steps)[None, :], len(emit) - 1)
            e = emit[where]
            a, b = np.zeros((n, steps, n_tags)), np.zeros((n, steps, n_tags))
            a[:, 0] = e[:, 0]
            for t in range(1, steps):
                a[:, t] = e[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + theta[2], axis=1)
            for t in range(steps - 2, -1, -1):
                after = np.logaddexp.reduce(theta[2][None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(inside[:, t + 1, None], after, 0.0)
            z = np.logaddexp.reduce(a[np.arange(n), counts - 1], axis=1)
            share = np.exp(np.minimum(0, a + b - z[:, None, None]))
            tags = np.concatenate([m[3] for m in chosen])
            error = np.zeros((len(emit), n_tags))
            error[np.arange(len(tags)), tags] = 1.0
            error -= share[inside]
            move = np.zeros((n_tags, n_tags))
            for t in range(1, steps):
                live = inside[:, t]
                path = a[live, t - 1, :, None] + theta[2] + (e[live, t] + b[live, t])[:, None, :] - z[live, None, None]
                move -= np.exp(np.minimum(0, path)).sum(0)
            first = np.ones(len(tags), bool)
            first[offset] = False
            np.add.at(move, (tags[:-1][first[1:]], tags[1:][first[1:]]), 1.0)
            grads = [np.stack([np.bincount(rows, error[owner, k] * scale, D.BUCKETS) for k in range(n_tags)], axis=1), dense.T @ error, move]
            step += 1
            for k, g in enumerate(grads):
                g = g / n - decay * len(made) / n * theta[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                theta[k] += rate * (1 - (step - 1) / n_steps) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return D.Field(theta[0], theta[1], theta[2], field.grams)


def measure(field: D.Field, data: list[tuple[str, list[str], list[int], str]]) -> tuple[float, dict[str, float]]:
    """Share of clauses tagged rightly, and share of answers judged as constructed, by kind."""
    told, tagged = field.tag([field.problem(p) for p, *_ in data], [parts for _, parts, _, _ in data])
    right = sum(int((t == np.array(y)).sum()) for t, (_, _, y, _) in zip(tagged, data, strict=True))
    want = {"answer": None, "unfinished": "truncated", "echo": "copy", "foreign": "language", "hollow": "empty"}
    kinds: dict[str, list[bool]] = {}
    for (problem, _, _, kind), mine, tags in zip(data, told, tagged, strict=True):
        got = D.judge(field.problem(problem), mine, tags)
        kinds.setdefault(kind, []).append(got == want.get(kind, kind))
    return right / sum(len(y) for _, _, y, _ in data), {k: round(sum(v) / len(v), 4) for k, v in sorted(kinds.items())}


def read_rows(folder: str, sample: int = SAMPLE, seed: int = 1) -> list[tuple[str, str, str | None]]:
    table = pq.read_table(f"{folder}/sft_pairs.parquet", columns=["problem", "solution", "lang"])
    rows = [(p, s, lang) for p, s, lang in zip(*(table.column(c).to_pylist() for c in ("problem", "solution", "lang")), strict=True) if p and s]
    return random.Random(seed).sample(rows, min(sample, len(rows)))


def train(rows: list[tuple[str, str, str | None]], **options: float) -> D.Field:
    n_tags = len(D.TAGS)
    field = D.Field(np.zeros((D.BUCKETS, n_tags)), np.zeros((D.N_DENSE, n_tags)), np.zeros((n_tags, n_tags)), language_scores(rows))
    return fit(field, examples(field, rows, seed=7) + examples(field, rows, seed=6), **options)


def main(folder: str) -> None:
    rows = read_rows(folder)
    held, rest = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    field = train(rest)
    print("held-out pairs:", *measure(field, examples(field, held, seed=8)))
    print("held-out pairs, declining sentences kept out of training:", measure(field, examples(field, held, seed=9, refusals=slice(2, None, 3)))[1]["refusal"])
    hashed = np.where(np.abs(field.hashed) < 0.02, 0, field.hashed)
    np.savez_compressed(Path(__file__).parent / "defect_crf.npz", hashed=np.round(hashed * 64).astype(np.int16).astype(np.float16) / 64, dense=field.dense, move=field.move, grams=np.round(field.grams * 8).astype(np.float16) / 8)


if __name__ == "__main__":
    main(sys.argv[1])
