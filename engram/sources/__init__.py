"""engram.sources"""
