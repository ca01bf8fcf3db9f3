"""Corpus layouts as data.

A spec describes one manifest layout: delimiter, header handling, and how
each utterance field is built from the split columns (``c0``, ``c1`` ...),
literals and path-derived parts. ``manifest.parse_lines`` renders a spec to
Spark column expressions; ``manifest.parse_sql`` renders the same spec to
SQL, so every layout has an oracle. Custom layouts: ``register_spec``.

Field templates are lists of parts:
  ("lit", s)                 literal
  ("col", i, *ops)           split column i with ops: trim, nospace, mp3wav, upto_us, chapter
  ("name", header, *ops)     column located by header name (header layouts)
  ("root",)                  the dataset root folder
  ("path_re", regex, group)  regex group of the source file path
  ("path_dir",)              folder of the source file path
  ("field", name)            another built field
"""

from __future__ import annotations

SPECS: dict[str, dict] = {}


def register_spec(name: str, spec: dict) -> None:
    SPECS[name] = spec


def _s(name, **kw):
    register_spec(name, kw)


R = ("root",)

_s("cml_tts", sep="|", header=True, text=[("name", "transcript")], audio=[R, ("lit", "/"), ("name", "wav_filename")],
   speaker=[("name", "client_id")], speaker_default="default", emotion_default="neutral",
   ignore_on="speaker_name", exists=True)
_s("coqui", sep="|", header=True, text=[("name", "text")], audio=[R, ("lit", "/"), ("name", "audio_file")],
   speaker=[("name", "speaker_name")], speaker_default="coqui", emotion_default="neutral",
   ref=[R, ("lit", "/"), ("name", "ref_file")], ref_default="null", language=[("name", "language")],
   ignore_on="speaker_name", exists=True)
_s("tweb", sep="\t", text=[("col", 1)], audio=[R, ("lit", "/"), ("col", 0), ("lit", ".wav")], speaker_const="tweb")
_s("mozilla", sep="|", text=[("col", 0, "trim")], audio=[R, ("lit", "/wavs/"), ("col", 1, "trim")], speaker_const="mozilla")
_s("mozilla_de", sep="|", strip_line=True, encoding="ISO-8859-1", text=[("col", 1, "trim")],
   audio=[R, ("lit", "/BATCH_"), ("col", 0, "trim", "upto_us"), ("lit", "_FINAL/"), ("col", 0, "trim")],
   speaker_const="mozilla")
_s("mailabs", sep="|", text=[("col", 1, "trim")], audio=[("path_dir",), ("lit", "/wavs/"), ("col", 0), ("lit", ".wav")],
   speaker=[("path_re", "by_book/(male|female)/([^/]+)/", 2)], require_speaker=True, ignore_on="speaker_name",
   exists=True)
_s("ljspeech", sep="|", text=[("col", 2)], audio=[R, ("lit", "/wavs/"), ("col", 0), ("lit", ".wav")], speaker_const="ljspeech")
_s("ljspeech_test", sep="|", text=[("col", 2)], audio=[R, ("lit", "/wavs/"), ("col", 0), ("lit", ".wav")],
   speaker_by_line_pair="ljspeech-")
_s("thorsten", sep="|", text=[("col", 1)], audio=[R, ("lit", "/wavs/"), ("col", 0), ("lit", ".wav")], speaker_const="thorsten")
_s("ruslan", sep="|", text=[("col", 1)], audio=[R, ("lit", "/RUSLAN/"), ("col", 0), ("lit", ".wav")], speaker_const="ruslan")
_s("css10", sep="|", text=[("col", 1)], audio=[R, ("lit", "/"), ("col", 0)], speaker_const="css10")
_s("nancy", nancy=True, audio_prefix="/wavn/", speaker_const="nancy")
_s("common_voice", sep="\t", skip_prefix="client_id", text=[("col", 2)],
   audio=[R, ("lit", "/clips/"), ("col", 1, "mp3wav")], speaker=[("lit", "MCV_"), ("col", 0)], ignore_on="raw_speaker",
   raw_speaker=[("col", 0)])
_s("libri_tts", sep="\t", text=[("col", 2)],
   audio=[R, ("lit", "/"), ("col", 0, "upto_us"), ("lit", "/"), ("col", 0, "chapter"), ("lit", "/"), ("col", 0), ("lit", ".wav")],
   speaker=[("lit", "LTTS_"), ("col", 0, "upto_us")], raw_speaker=[("col", 0, "upto_us")], ignore_on="raw_speaker",
   require_all=True)
_s("custom_turkish", sep="|", text=[("col", 1, "trim")], audio=[R, ("lit", "/wavs/"), ("col", 0, "trim"), ("lit", ".wav")],
   speaker_const="turkish-female", exists=True)
_s("brspeech", sep="|", skip_prefix="wav_filename", text=[("col", 2)], audio=[R, ("lit", "/"), ("col", 0)],
   speaker=[("col", 3)], ignore_on="speaker_name")
_s("mls", sep="\t", text=[("col", 1)],
   audio=[R, ("lit", "/audio/"), ("col", 0, "upto_us"), ("lit", "/"), ("col", 0, "chapter"), ("lit", "/"), ("col", 0), ("lit", ".wav")],
   speaker=[("lit", "MLS_"), ("col", 0, "upto_us")], raw_speaker=[("col", 0, "upto_us")], ignore_on="raw_speaker")
_s("emotion", sep=",", skip_prefix="file_path", audio=[R, ("lit", "/"), ("col", 0)], speaker=[("col", 1)],
   emotion=[("col", 2)], ignore_on="speaker_name")
_s("baker", sep="|", exact_fields=2, text=[("col", 1)], audio=[R, ("lit", "/clips_22/"), ("col", 0)], speaker_const="baker")
_s("kokoro", sep="|", text=[("col", 2, "nospace")], audio=[R, ("lit", "/wavs/"), ("col", 0), ("lit", ".wav")], speaker_const="kokoro")
_s("kss", sep="|", text=[("col", 2)], audio=[R, ("lit", "/"), ("col", 0)], speaker_const="kss")
_s("bel_tts", sep="|", text=[("col", 1)], audio=[R, ("lit", "/"), ("col", 0)], speaker_const="bel_tts")

# one text file per clip: text is the first line; speaker / id come from the path
_s("vctk", per_file=True, path_re="txt/([^/]+)/([^/.]+)", text_first_line=True,
   audio=[R, ("lit", "/wav48_silence_trimmed/"), ("field", "spk"), ("lit", "/"), ("field", "fid"), ("field", "mic"), ("lit", ".flac")],
   speaker=[("lit", "VCTK_"), ("field", "spk")], mic="mic1", mic_forced={"p280": "mic1"}, ignore_on="raw_speaker", exists=True)
_s("vctk_old", per_file=True, path_re="txt/([^/]+)/([^/.]+)", text_first_line=True,
   audio=[R, ("lit", "/wav48/"), ("field", "spk"), ("lit", "/"), ("field", "fid"), ("lit", ".wav")],
   speaker=[("lit", "VCTK_old_"), ("field", "spk")], ignore_on="raw_speaker")
_s("open_bible", per_file=True, path_re="([^/]+)/([^/]+)/([^/.]+)\\.txt$", split_dir=True, text_first_line=True,
   audio=[R, ("lit", "/"), ("field", "split"), ("lit", "/"), ("field", "spk"), ("lit", "/"), ("field", "fid"), ("lit", ".flac")],
   speaker=[("lit", "OB_"), ("field", "spk")], drop_digits=True, ignore_on="raw_speaker")
