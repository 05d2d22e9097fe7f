"""engram.streaming"""
