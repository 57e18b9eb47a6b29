from memberlens.functions import keys, labels, measures

__all__ = ["keys", "labels", "measures"]
