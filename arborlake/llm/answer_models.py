"""Models of P1: languages and refusals, learned from sample sentences and then from the whole log.

Both are naive Bayes over hashed character n-grams. Sample sentences start them; every response of the
log then adds its n-grams to the class it belongs to beyond doubt, so that the models speak the log's
words. Their tables have a fixed size, whatever the log's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import regex

# Sample sentences the language model starts from.
SEEDS = {
    "zh": "我们在这里说明情况，请大家先看完整份材料，再提出意见。这个方案已经讨论过，多数人认为可以保留，只有少数内容需要修改。因此建议先完成前两项工作，然后再安排下一步。如果时间不够，可以把会议推迟到下周。他们的办法很简单，但是效果不错，也更便于管理。两者之间没有重复，不必合并为一个。",
    "en": "We explain the matter here, so please read the whole paper before you give your view. This plan was discussed and most people think it can stay, while only a few parts need a change. It is better to finish the first two tasks and then arrange the next step. If there is not enough time, the meeting can move to next week. Their way is simple but it works well and is easier to manage. The two of them do not overlap, because each has its own purpose.",
    "ja": "ここで事情を説明しますので、資料を最後まで読んでから意見を出してください。この案はすでに話し合い、多くの人が残してもよいと考えていますが、一部は直す必要があります。まず最初の二つの仕事を終えて、それから次の段階を決めるのがよいでしょう。時間が足りない場合は、会議を来週に延ばすことができます。方法は簡単ですが、効果があり管理もしやすいです。",
    "ko": "여기에서 상황을 설명하니 자료를 끝까지 읽고 의견을 내 주십시오. 이 계획은 이미 논의되었고 많은 사람이 유지해도 된다고 생각하지만 일부는 고쳐야 합니다. 먼저 처음 두 가지 일을 끝내고 다음 단계를 정하는 것이 좋습니다. 시간이 부족하면 회의를 다음 주로 미룰 수 있습니다. 방법은 간단하지만 효과가 있고 관리하기도 쉽습니다.",
    "fr": "Nous expliquons ici la situation, veuillez donc lire tout le document avant de donner votre avis. Ce projet a été discuté et la plupart des gens pensent qu'il peut rester, mais quelques parties doivent changer. Il vaut mieux finir les deux premières tâches puis préparer la suite. S'il n'y a pas assez de temps, la réunion peut être déplacée à la semaine prochaine. Leur manière est simple mais elle marche bien et elle est plus facile à gérer.",
    "es": "Aquí explicamos la situación, así que lea todo el documento antes de dar su opinión. Este plan ya se discutió y la mayoría de la gente cree que puede quedar, pero algunas partes necesitan un cambio. Es mejor terminar las dos primeras tareas y luego preparar el siguiente paso. Si no hay tiempo suficiente, la reunión puede pasar a la semana próxima. Su manera es sencilla pero funciona bien y es más fácil de manejar.",
    "de": "Wir erklären hier die Lage, bitte lesen Sie also das ganze Papier, bevor Sie Ihre Meinung sagen. Dieser Plan wurde besprochen und die meisten Leute denken, dass er bleiben kann, aber einige Teile müssen geändert werden. Es ist besser, zuerst die beiden ersten Aufgaben zu beenden und dann den nächsten Schritt zu planen. Wenn die Zeit nicht reicht, kann die Sitzung auf die nächste Woche verschoben werden. Der Weg ist einfach und leicht zu verwalten.",
    "ru": "Здесь мы объясняем положение дел, поэтому прочитайте весь документ, прежде чем высказать мнение. Этот план уже обсудили, и большинство людей считает, что его можно оставить, но некоторые части нужно изменить. Лучше сначала закончить первые две задачи, а затем подготовить следующий шаг. Если времени не хватает, встречу можно перенести на следующую неделю. Их способ простой, но он хорошо работает.",
    "pt": "Aqui explicamos a situação, por isso leia todo o documento antes de dar a sua opinião. Este plano já foi discutido e a maioria das pessoas acha que pode ficar, mas algumas partes precisam de uma mudança. É melhor terminar as duas primeiras tarefas e depois preparar o próximo passo. Se não houver tempo suficiente, a reunião pode passar para a próxima semana. O modo é simples mas funciona bem.",
    "it": "Qui spieghiamo la situazione, quindi leggete tutto il documento prima di dare la vostra opinione. Questo piano è già stato discusso e la maggior parte delle persone pensa che possa restare, ma alcune parti hanno bisogno di un cambiamento. È meglio finire i primi due compiti e poi preparare il passo seguente. Se non c'è abbastanza tempo, la riunione può passare alla prossima settimana.",
}
# Sample sentences that decline a task.
DECLINES = {
    "zh": "对不起，我无法帮助您完成这个请求。很遗憾，我没有权限处理该任务。抱歉，我不能回答这个问题。根据有关规定，不便答复。作为人工智能助手，我无法对此作出判断。作为语言模型，我不能评论这类内容。这个问题超出了我的能力范围。由于内容限制，无法提供协助。此请求不予处理，请联系人工。该内容涉及敏感信息，暂不讨论。这件事我帮不了您，建议咨询主管部门。恕我无法作答，如有其他问题，我很乐意帮忙。恕难从命。我拒绝回答这个要求。",
    "en": "I'm sorry, but I can't help with that. I am unable to answer this question. Unfortunately I cannot assist with this request. As an AI language model, I can't provide a judgement. I must decline this task. This is outside of what I can do. It is beyond my abilities. I won't be able to comply. I cannot comment on this because of content policy. No answer can be given. I am not able to discuss this. I am not permitted to respond. Please contact the office in charge. A human should take over. If you have another question, I am happy to help.",
    "ja": "申し訳ありませんが、そのご質問にはお答えできません。ご要望には対応できません。", "ko": "죄송하지만 그 질문에는 답변할 수 없습니다. 도와드릴 수 없습니다.",
    "fr": "Désolé, je ne peux pas vous aider. Je ne suis pas en mesure de répondre à cette demande.", "es": "Lo siento, no puedo ayudar con esa solicitud. No puedo responder a esta pregunta.",
    "de": "Leider kann ich dabei nicht helfen. Ich kann diese Anfrage nicht beantworten.", "ru": "К сожалению, я не могу помочь с этим запросом. Я не могу ответить на этот вопрос.",
    "pt": "Desculpe, não posso ajudar com esse pedido.", "it": "Mi dispiace, non posso aiutare con questa richiesta.",
}

LANGUAGES = tuple(SEEDS)
#: Hash buckets of n-grams: the size of every table, whatever the log.
BUCKETS = 1 << 16
_SCRIPTS = np.array([0, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x400, 0x500, 0x1100, 0x1200, 0x3040, 0x3100, 0x3400, 0x4DC0, 0x4E00, 0xA000, 0xAC00, 0xD7B0], np.uint32)
# per range: 0 other, 1 Latin, 2 Cyrillic, 3 Hangul, 4 kana, 5 Han
_SCRIPT_OF = np.array([0, 1, 0, 1, 0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 5, 0, 3, 0])
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}\x00]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def grams(texts: Sequence[str], sizes: Sequence[int], scripts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every character n-gram of the texts, by array operations over all of
    them. scripts adds the script of every letter, twice, in buckets of its own."""
    joined = _NO_LETTERS.sub(" ", unicodedata.normalize("NFKC", "\x00".join(t.replace("\x00", " ") for t in texts)).lower())
    code = np.frombuffer((" " + joined.replace("\x00", " \x00 ") + " ").encode("utf-32-le", "replace"), np.uint32)
    owner, wide = np.cumsum(code == 0), code.astype(np.uint64)
    buckets, owners, h = [], [], None
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            h = wide * _MULT if n == 1 else h[:-1] * _STEP + wide[n - 1 :]
            if n not in sizes:
                continue
            ok = (owner[: len(h)] == owner[n - 1 :]) & (code[: len(h)] != 0)
            if n == 1:
                ok &= code != 32
            mixed = (h[ok] ^ (h[ok] >> np.uint64(29))) * _MULT
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 8))
            owners.append(owner[: len(h)][ok])
    if scripts:
        letter = (code != 0) & (code != 32)
        kind = _SCRIPT_OF[np.searchsorted(_SCRIPTS, code[letter], "right") - 1] + BUCKETS - 8
        buckets += [kind, kind]
        owners += [owner[letter]] * 2
    return np.concatenate(buckets), np.concatenate(owners)


class LanguageModel:
    """Posterior of each language, and of none of them, by n-grams of length 1 to 3 and scripts."""

    SIZES = (1, 2, 3)

    def __init__(self, log_counts: np.ndarray | None = None, alpha: float = 0.3):
        """log_counts: (languages, BUCKETS) counts of the log's own sentences."""
        b, o = grams(list(SEEDS.values()), self.SIZES, True)
        counts = np.zeros((len(LANGUAGES), BUCKETS))
        np.add.at(counts, (o, b), 1.0)
        if log_counts is not None:  # samples weigh as much as the log's evidence at most
            counts = counts * np.maximum(1.0, log_counts.sum(1, keepdims=True) / counts.sum(1, keepdims=True) / 4) + log_counts
        kinds = np.count_nonzero(counts.any(0))
        total = counts.sum(1, keepdims=True) + alpha * kinds
        # one denominator for all, so that an unseen n-gram favours no language but the unknown one
        least = 2_000 + alpha * kinds
        self.log = np.vstack([np.log((counts * least / total + alpha) / least), np.full((1, BUCKETS), np.log(2 * alpha / least))]).astype(np.float32)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Log-likelihoods, a row per text: LANGUAGES, then unknown."""
        b, o = grams(texts, self.SIZES, True)
        return np.stack([np.bincount(o, row[b], len(texts)) for row in self.log], 1)

    @staticmethod
    def posterior(scores: np.ndarray) -> np.ndarray:
        e = np.exp(np.maximum(scores - scores.max(-1, keepdims=True), -700))
        return e / e.sum(-1, keepdims=True)


class RefusalModel:
    """Log-odds that a response declines its task, by n-grams of length 2 to 4; a response's is the sum
    of its sentences'."""

    SIZES = (2, 3, 4)
    #: Log-odds a response needs to teach the model what a refusal is, and to be taken for one: far
    #: above 0, as overlapping n-grams count a hint several times.
    TEACHES, DECLINES = 20.0, 10.0

    def __init__(self, answers: np.ndarray, refusals: np.ndarray | None = None, alpha: float = 0.5, scale: float = 20_000):
        """answers, refusals: BUCKETS counts of the log (at first everything in it is an answer)."""
        b, _ = grams(list(DECLINES.values()), self.SIZES)
        own = np.bincount(b, minlength=BUCKETS).astype(float)
        if refusals is not None and refusals.sum():
            own = own * max(1.0, refusals.sum() / own.sum() / 4) + refusals
        # the languages' plain sentences are answers as well, so that no language as such declines
        b, _ = grams(list(SEEDS.values()), self.SIZES)
        plain = np.bincount(b, minlength=BUCKETS)
        answers = answers + plain * max(1.0, 0.5 * answers.sum() / plain.sum())
        level = lambda x: x * scale / max(x.sum(), 1.0)  # noqa: E731  (equal totals: an unseen n-gram says nothing)
        self.log = np.log((level(own) + alpha) / (level(answers) + alpha)).astype(np.float32)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        b, o = grams(texts, self.SIZES)
        return np.bincount(o, self.log[b], len(texts))
