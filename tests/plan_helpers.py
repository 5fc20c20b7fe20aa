"""What tests read from plans."""


def plan_text(frame) -> str:
    return frame._jdf.queryExecution().toString()
